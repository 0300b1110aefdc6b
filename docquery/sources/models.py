"""A client for a local model daemon that speaks JSON over HTTP: models, embeddings, chat.

Its methods take batches, so they fit ``embed.with_function``, ``answer.generate`` and evaluation
judges; on executors each worker makes its own connection.  ``send`` can be replaced in tests.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen


class ModelError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def post(url: str, body: Mapping[str, Any] | None, timeout: float) -> Any:
    """GET without a body, else POST; the reply's JSON."""
    request = Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read() or b"{}")
    except HTTPError as e:
        text = e.read().decode("utf-8", "replace")
        try:
            text = json.loads(text)["error"]
        except (ValueError, KeyError, TypeError):
            pass
        raise ModelError(f"{url}: {e.code} {str(text)[:300]}", e.code) from e
    except (URLError, OSError, ValueError) as e:
        raise ModelError(f"{url}: {e}") from e


@dataclass(frozen=True)
class ModelClient:
    base_url: str = "http://127.0.0.1:11434"
    chat_model: str = ""
    embedding_model: str = ""
    timeout: float = 120.0
    send: Callable[[str, Mapping[str, Any] | None, float], Any] = post

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "DOCQUERY_MODEL_") -> "ModelClient":
        given = {f: env[prefix + f.upper()].strip() for f in ("base_url", "chat_model", "embedding_model") if env.get(prefix + f.upper(), "").strip()}
        seconds = float(env.get(prefix + "TIMEOUT", "") or cls.timeout)
        if seconds <= 0:
            raise ValueError("the timeout must be positive")
        return cls(**given, timeout=seconds)

    def with_models(self, chat: str | None = None, embedding: str | None = None) -> "ModelClient":
        return replace(self, chat_model=chat or self.chat_model, embedding_model=embedding or self.embedding_model)

    def _call(self, path: str, body: Mapping[str, Any] | None = None) -> Any:
        return self.send(self.base_url.rstrip("/") + path, body, self.timeout)

    def list_models(self) -> list[str]:
        found = self._call("/api/tags").get("models", [])
        return sorted({m.get("name") or m.get("model") for m in found} - {None, ""})

    def pull(self, model: str) -> None:
        self._call("/api/pull", {"model": model, "stream": False})

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """Vectors of a batch; a daemon without the batch call is asked text by text."""
        if not texts:
            return []
        try:
            vectors = self._call("/api/embed", {"model": self.embedding_model, "input": list(texts)}).get("embeddings", [])
        except ModelError as e:
            if e.status != 404:
                raise
            vectors = [self._call("/api/embeddings", {"model": self.embedding_model, "prompt": t}).get("embedding", []) for t in texts]
        if len(vectors) != len(texts) or not all(vectors):
            raise ModelError(f"{len(vectors)} vectors for {len(texts)} texts, or empty ones")
        return [[float(x) for x in v] for v in vectors]

    def complete(self, prompts: Sequence[str], system: str | None = None) -> list[str]:
        """Answers to a batch of prompts."""
        out = []
        for p in prompts:
            messages = [{"role": "system", "content": system}] if system else []
            reply = self._call("/api/chat", {"model": self.chat_model, "messages": [*messages, {"role": "user", "content": p}], "stream": False})
            text = (reply.get("message") or {}).get("content", "")
            if not text.strip():
                raise ModelError("the answer is empty")
            out.append(text)
        return out
