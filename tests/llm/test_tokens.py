import base64
import random
from pathlib import Path

import tiktoken

from docquery.llm import tokens


def encoding():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def test_words_against_reference_merges():
    random.seed(1)
    e, m = encoding(), tokens.Merger(Path(tokens.VOCABULARY).read_bytes())
    words = ["a" * n for n in range(1, 40)] + ["".join(random.choices("abtheingor é日", k=random.randrange(1, 30))) for _ in range(2000)] + ["", "x" * 5000]
    want = [len(e._core_bpe.encode_single_piece(w.encode())) if w else 0 for w in words]
    assert m.count([w.encode() for w in words]).tolist() == want


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    e = encoding()
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(d).collect()}
    assert got == {r["doc_id"]: len(e.encode_ordinary(r["text"])) for r in d.collect()}


def test_hostile_rows(hostile, empty):
    e = encoding()
    got = tokens.token_counts(hostile).collect()
    want = [(r["doc_id"], None if r["text"] is None else len(e.encode_ordinary(r["text"]))) for r in hostile.collect()]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted(want, key=repr)
    assert tokens.token_counts(empty).count() == 0
