import math

import pytest
from pyspark.sql import functions as F

from docquery.operators import answer, embed, evaluate, index, retrieve
from docquery.operators.filters import FilterSpec, NumericRange
from docquery.operators.query import analyse
from docquery.plans import pipeline
from docquery.plans.config import HybridSettings, Settings
from docquery.plans.service import Service
from docquery.sources.models import ModelClient, ModelError
from docquery.sources.store import FrameStore, TableStore
from docquery.streaming import ingest

WORDS = "switchport vlan interface hurricane wind latency loss revenue quarter device page".split()


def vector(text):
    low = text.lower()
    return [float(low.count(w)) for w in WORDS] + [0.1]


ROWS = [
    ("c1", "d1", "cisco", "interface Gi1/0/24\n switchport access vlan 10", {"cisco_feature": "interface", "cisco_section": "Gi1/0/24", "tags": ["net"]}),
    ("c2", "d2", "pdf", "On this page the hurricane wind grew", {"page_number": 12, "section": "Storm"}),
    ("c3", "d3", "excel", "Revenue | Quarter\n10 | Q1", {"sheet_name": "Sales", "column_names": ["Revenue", "Quarter"], "row_start": 1, "row_end": 2, "tags": ["fin", "net"]}),
    ("c4", "d4", "json", "device.metrics.latency: 20\ndevice.metrics.loss: 1", {"json_key_path": "device.metrics", "custom": '{"level": {"n": "7"}}'}),
    ("c5", "d5", "docx", "A section about the wind", {"section": "Wind Power"}),
    ("c6", "d6", "text", "Nothing of note", {}),
]


@pytest.fixture(scope="module")
def chunks(spark):
    kinds = ", ".join(f"{k} {v}" for k, v in index.METADATA.items() if k not in ("document_id", "source_type"))
    names = [k for k in index.METADATA if k not in ("document_id", "source_type")]
    rows = [(c, d, s, t, vector(t), *(m.get(n) for n in names)) for c, d, s, t, m in ROWS]
    d = spark.createDataFrame(rows, f"chunk_id string, document_id string, source_type string, text string, embedding array<double>, {kinds}")
    return index.stored(d).cache()


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_query_analysis():
    q = analyse('show  vlan 10 on Gi1/0/24 "exact words" page 12 of sheet Sales')
    assert q.normalized.startswith("show vlan 10") and "gi1/0/24" in q.tokens and q.quoted_phrases == ("exact words",)
    assert "vlan 10" in q.technical_terms and q.hints.page_numbers == (12,) and q.hints.sheet_names == ("Sales",)
    assert set(q.hints.preferred_source_types) >= {"pdf", "excel", "cisco"}
    with pytest.raises(ValueError):
        analyse("  ")


def test_modes_and_ranks(chunks):
    s = Service(chunks, embed=vector)
    assert ids(s.retrieve("switchport vlan 10 interface Gi1/0/24").results)[0] == "c1"
    assert ids(s.retrieve("device.metrics.latency", "hybrid").results)[0] == "c4"
    assert ids(s.retrieve("hurricane wind", "dense", 2).results)[0] == "c2"
    r = s.retrieve("wind", "keyword", 5, FilterSpec(numeric_ranges={"page_number": NumericRange(gte=10, lte=12)}))
    assert ids(r.results) == ["c2"] and {"analyse", "plan"} <= set(r.timings)
    assert ids(s.retrieve("revenue quarter", None, 5, FilterSpec(equals={"sheet_name": "Sales"})).results) == ["c3"]
    with pytest.raises(ValueError):
        s.retrieve("x", "magic")


def test_keyword_scores_by_hand(chunks):
    r = {x["chunk_id"]: x["score"] for x in retrieve.keyword(chunks, analyse("wind"), 10).collect()}
    idf = math.log(7 / 3) + 1
    assert abs(r["c2"] - idf) < 1e-9 and abs(r["c5"] - (idf + 0.8)) < 1e-9  # c5 has it in its section as well
    assert retrieve.keyword(chunks, analyse("zzz"), 10).count() == 0


def test_fusion_strategies(chunks):
    q = analyse("wind hurricane")
    w = {r["chunk_id"]: r for r in retrieve.hybrid(chunks, q, vector("wind hurricane"), 5).collect()}
    p = Settings().profile_for("pdf")
    wd, wk = 0.65 * p.dense_weight, 0.35 * p.keyword_weight
    assert abs(w["c2"]["fused_score"] - 1.0) < 1e-9
    rrf = retrieve.hybrid(chunks, q, vector("wind hurricane"), 5, settings=Settings(hybrid=HybridSettings(fusion_strategy="rrf"))).where("chunk_id = 'c2'").first()
    assert abs(rrf["fused_score"] - (wd / 61 + wk / 61) / (wd + wk)) < 1e-9


def test_rerank_boosts(chunks):
    q = analyse("page 12 hurricane wind")
    r = retrieve.rerank(retrieve.keyword(chunks, q, 10), q).where("chunk_id = 'c2'").first()
    assert set(r["applied_boosts"]) >= {"page_match", "source_hint"}
    q = analyse("revenue column of sheet Sales")
    r = retrieve.rerank(retrieve.keyword(chunks, q, 10), q).where("chunk_id = 'c3'").first()
    assert set(r["applied_boosts"]) >= {"sheet_match", "column_match", "metadata_match"}
    q = analyse("device.metrics.latency")
    r = retrieve.rerank(retrieve.keyword(chunks, q, 10), q).where("chunk_id = 'c4'").first()
    assert "json_path_match" in r["applied_boosts"]


def test_filters(chunks):
    run = lambda **k: sorted(ids(FilterSpec(**k).apply(chunks)))
    assert run(tags_any=["net"]) == ["c1", "c3"] and run(tags_all=["net", "fin"]) == ["c3"]
    assert run(contains={"column_names": "quart"}) == ["c3"] and run(contains={"section": "WIND"}) == ["c5"]
    assert run(equals={"custom.level.n": "7"}) == ["c4"] and run(any_of={"source_type": []}) == [] and run(equals={"none": 1}) == []
    assert run(equals={"page_number": None, "source_type": "text"}) == ["c6"] and FilterSpec().is_empty


def test_vectors(spark, chunks):
    a = embed.hashed("switchport vlan 10")
    assert len(a) == 512 and abs(sum(x * x for x in a) - 1) < 1e-9 and embed.hashed("") == [0.0] * 512
    with pytest.raises(Exception, match="dimension"):
        retrieve.dense(chunks, [1.0, 2.0]).count()
    assert FrameStore(chunks).dimension() == len(WORDS) + 1
    assert {r["score"] for r in retrieve.dense(chunks, [0.0] * (len(WORDS) + 1)).collect()} == {0.0}
    d = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r["v"] for r in d.select(embed.with_function(F.col("t"), lambda b: [[float(len(x))] for x in b], 1).alias("v")).collect()] == [[2.0], None]


def test_answers(chunks):
    s = Service(chunks, embed=vector)
    found, route = s.ask("what is said of the hurricane wind?")
    assert found.first()["content"].startswith("Nothing in") and route["domain"] is None
    named = chunks.withColumn("domain", F.lit("general")).withColumn("filename", F.lit("f.pdf"))
    row, route = Service(named, embed=vector).ask("hurricane wind", "keyword")
    assert "[f.pdf • p.12]" in row.first()["content"] and route["filter_applied"]
    p = answer.prompt(retrieve.keyword(named, analyse("wind"), 5), "wind").first()["prompt"]
    assert "[1] " in p and "Question: wind" in p
    out = answer.generate(answer.prompt(named.withColumn("score", F.lit(1.0)), "wind"), lambda batch: ["<think>hm</think> yes" for _ in batch])
    assert out.first()["answer"] == "yes"


def test_evaluation(spark):
    rows = [("q", "a", ["c"], "r"), ("q", "a", ["c"], None), ("q", "", ["c"], None), ("q", "a", [], None)]
    d = spark.createDataFrame(rows, "user_input string, response string, retrieved_contexts array<string>, reference string")

    def judge(metric, row):
        if metric == "faithfulness":
            raise RuntimeError("no")
        return 0.5

    r = [x["results"] for x in evaluate.evaluate(d, judge).collect()]
    assert [m["metric"] for m in r[0]] == ["faithfulness", "context_utilization", "context_precision", "context_recall"]
    assert r[0][0]["error"] == "RuntimeError: no" and r[0][1]["score"] == 0.5 and len(r[1]) == 2
    assert r[2][0]["error"] == "there is no response" and r[3][0]["error"] == "there are no contexts"
    (skipped,) = evaluate.evaluate(d.limit(2).where("reference is null"), judge, ["Context Recall"]).first()["results"]
    assert skipped["skipped"] and evaluate.metric_name("groundedness") == "faithfulness"
    assert evaluate.is_reasoning_model("deepseek-r1:7b") and not evaluate.is_reasoning_model("llama3")


def test_store(spark, chunks, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"))
    s.replace(chunks.limit(4))
    s.append(chunks)
    assert s.chunks().count() == 6 and ids(s.get(["c5", "none", "c2"])) == ["c5", "c2"]
    s.remove_documents(spark.createDataFrame([("d1",), ("d2",)], "document_id string"))
    assert sorted(ids(s.page(2, 1))) == ["c4", "c5"] and len(s.page(1).first()["preview"]) == 8
    s.reindex(s.chunks().select("chunk_id", F.array(F.lit(1.0)).alias("embedding")))
    assert s.dimension() == 1
    s.drop_old()
    s.clear()
    assert s.chunks().count() == 0


def test_model_client():
    calls = []

    def send(url, body, timeout):
        calls.append((url, body))
        path = url.split("/api/")[1]
        if path == "embed":
            raise ModelError("no such call", 404)
        return {"tags": {"models": [{"name": "b"}, {"model": "a"}]}, "embeddings": {"embedding": [1, 2]}, "chat": {"message": {"content": "hi"}}, "pull": {}}[path]

    c = ModelClient(send=send).with_models("m", "e")
    assert c.list_models() == ["a", "b"] and c.embed(["x", "y"]) == [[1.0, 2.0]] * 2 and c.embed([]) == [] and c.complete(["p"], "s") == ["hi"]
    assert calls[-1][1]["messages"][0] == {"role": "system", "content": "s"} and calls[-1][1]["stream"] is False
    c.pull("z")
    with pytest.raises(ModelError):
        ModelClient(send=lambda *a: {"message": {}}).complete(["p"])
    assert ModelClient.from_env({"DOCQUERY_MODEL_CHAT_MODEL": "q", "DOCQUERY_MODEL_TIMEOUT": "5"}).timeout == 5
    with pytest.raises(ModelError):
        ModelClient(base_url="http://127.0.0.1:9", timeout=1).list_models()


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"retrieval_mode": "dense", "vector": {"top_k": 3}, "source_profiles": {"pdf": {"dense_weight": 1, "keyword_weight": 0, "metadata_weight": 0, "exact_match_weight": 0}}}')
    s = Settings.from_json_file(str(path))
    assert (s.retrieval_mode, s.vector.top_k, s.profile_for("pdf").dense_weight, s.profile_for("?").dense_weight) == ("dense", 3, 1, 0.6)
    assert Settings.from_dict(s.to_dict()) == s


def test_streaming(spark, tmp_path):
    d = spark.createDataFrame([("1", "text", "a.txt", "One.\n\nTwo."), ("2", "cisco_config", "r.cfg", "interface Gi0/1\n shutdown")], "document_id string, source_type string, source string, content string")
    d.write.parquet(str(tmp_path / "in"))
    store = TableStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        q = ingest.index(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "check"), str(tmp_path / "postings"))
        q.awaitTermination(120)
    batch = pipeline.indexed(pipeline.run(d))
    assert sorted(ids(store.chunks())) == sorted(ids(batch))
    assert spark.read.parquet(str(tmp_path / "postings")).where("term = 'gi0/1'").count() == 1
    cleaned = ingest.cleaned(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    assert cleaned.isStreaming and "domain" in cleaned.columns


def test_excerpt_folds_each_part_once(spark):
    from pyspark.sql import functions as F

    from docquery.operators import answer

    d = spark.createDataFrame([("One the onti here. Nothing.\nOf  the ONTI, of it",), ("",), (None,), ("x" * 300,)], "t string").coalesce(1).select("t", answer.excerpt(F.col("t"), 'the onti "of the"').alias("e"))
    assert [r.e for r in d.collect()] == ["Of  the ONTI, of it", "", None, "x" * 240]
    assert d._jdf.queryExecution().analyzed().toString().count("lower(") == 1


def test_embedding_hashes_all_terms_of_a_text_at_once(monkeypatch):
    from docquery.functions import text
    from docquery.operators import embed

    import re

    odd = "Gi1/0/1 ΣΑΣ Straße Vlan10\u0301 STRASSE a.b[0].c Ꮳ the The x GiᏣ giᏣ"
    wanted = text.q_unique(text.q_lookup(t) for t in re.findall(text.TOKEN, odd) if len(t) >= 2)
    folded = []
    monkeypatch.setattr(text, "q_lookup", lambda s, f=text.q_lookup: folded.append(s) or f(s))
    assert text.q_tokens(odd, 2) == wanted
    assert not folded  # tokens are folded as one text
    assert embed.hashed("", 4) == embed.hashed("1 ?", 4) == [0.0] * 4


def test_postings_of_some_terms_are_those_of_the_whole_index(spark):
    from docquery.operators import index

    d = spark.createDataFrame([("1", "the onti the"), ("2", "of THE"), ("3", None), ("4", "")], "chunk_id string, search_text string")
    some, every = index.postings(d, only=["the", "of", "none"]), index.postings(d)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.where("term in ('the', 'of', 'none')").collect()))
