"""The model boundary, fetchers, embedders, and what stands around the stages."""

import json
import os
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import config as C
from tessera import schemas
from tessera.functions import embedders
from tessera.operators import models, recorded
from tessera.plans import cli, stages
from tessera.sources import fulltext, jsonl, services
from tessera.sources.http import HttpClient
from tessera.sources.store import Store

NOW = "2026-06-01 00:00:00"
PAPERS = "arxiv_id string, version int, title string, abstract string, authors array<string>, published timestamp, status string, created_at timestamp, updated_at timestamp"


def now():
    return F.lit(NOW).cast("timestamp")


# ------------------------------------------------------------------ clients


def test_mock_is_told():
    m = models.Mock({"needle": "found"}, {"S": {"a": 1}, "T": lambda prompt: {"b": len(prompt)}})
    assert [m.complete("a needle"), m.complete("hay")] == ["found", "mock-response"]
    assert m.structured("x", "S") == {"a": 1} and m.structured("xyz", "T") == {"b": 3}
    assert m.structured("x", recorded.JUDGEMENT) == {"is_relevant": False, "score": 0.0, "rationale": ""}
    assert m.calls == [("complete", "a needle"), ("complete", "hay"), ("S", "x"), ("T", "xyz"), (recorded.JUDGEMENT, "x")]
    m = models.Mock(lambda prompt: prompt.upper(), {"S": {"a": 1}}, handler=lambda kind, prompt, schema: {"h": schema} if "handled" in prompt else None)
    assert m.complete("abc") == "ABC" and m.structured("handled", "S") == {"h": "S"} and m.structured("other", "S") == {"a": 1}


def test_providers(monkeypatch):
    make = lambda **kw: models.factory(C.from_dict({"llm": kw}))
    assert make(provider="recorded") is None and make(provider="batch") is None
    told = make(provider="mock", mock_texts={"q": "a"}, mock_answers={"S": {"x": 1}}, mock_default="d")()
    assert (told.complete("q?"), told.complete("?"), told.structured("p", "S")) == ("a", "d", {"x": 1})
    monkeypatch.setenv("OTHER_KEY", "secret")
    api = make(provider="api", model="m", url="http://u", key_variable="OTHER_KEY")()
    assert (api.model, api.url, api.key) == ("m", "http://u", "secret")
    with pytest.raises(ValueError, match="no provider"):
        make(provider="else")


def test_api():
    sent = []

    def transport(url, body, headers, timeout):
        sent.append((url, json.loads(body), headers))
        return json.dumps({"content": [{"text": 'Here: {"score": 0.5, '}, {"text": '"rationale": "r"} done'}]}).encode()

    api = models.Api("m", "http://u", "k", HttpClient(transport, wait=0))
    assert api.structured("prompt", recorded.JUDGEMENT) == {"score": 0.5, "rationale": "r"}
    url, body, headers = sent[0]
    assert url == "http://u" and body["model"] == "m" and body["temperature"] == 0 and "is_relevant, score, rationale" in body["messages"][0]["content"] and headers["x-api-key"] == "k"


@pytest.mark.parametrize(
    ("said", "want", "calls"),
    [([{"score": 0.7}], {"score": 0.7}, 1), ([{"score": "high"}, {"score": 1.0}], {"score": 1.0}, 2), ([ValueError(), OSError()], None, 2), (["text", 5], None, 2)],
)
def test_one_more_attempt_then_a_stub(said, want, calls):
    left = list(said)

    def handler(kind, prompt, schema):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    m = models.Mock(handler=handler)
    got = models.answer(m, "p", recorded.JUDGEMENT)
    assert got == (want or recorded.zero_answer(recorded.JUDGEMENT) | {recorded.STUB: True})
    assert len(m.calls) == calls and all(("not valid" in p) == (k > 0) for k, (_, p) in enumerate(m.calls))


def test_stubs_are_told_apart(spark):
    fine = recorded.zero_answer(recorded.EXTRACTION) | {"method_summary": "m", "extraction_confidence": 0.8}
    rows = [("a", json.dumps(fine)), ("b", json.dumps(recorded.zero_answer(recorded.EXTRACTION) | {recorded.STUB: True})), ("c", json.dumps(recorded.zero_answer(recorded.EXTRACTION))), ("d", "[1]")]
    answers = spark.createDataFrame([(f"{recorded.EXTRACTION}:{k}", v) for k, v in rows], schemas.ANSWERS)
    reqs = answers.select("key", F.lit(recorded.EXTRACTION).alias("schema"), F.lit("p").alias("prompt"))
    chunked = spark.createDataFrame([], "paper_id string, chunks " + f"array<{schemas.CHUNK}>")
    found = recorded.extraction_rows(recorded.answered(reqs, answers, recorded.EXTRACTION), chunked, now(), "model-1")
    assert found.columns and set(found.columns) == set(schemas.EXTRACTIONS.names)
    assert {r["paper_id"]: (r["model"], r["extraction_confidence"]) for r in found.collect()} == {"a": ("model-1", 0.8), "b": ("stub", 0.0), "c": ("model-1", 0.0)}
    assert [r["key"] for r in recorded.pending(reqs, answers).collect()] == [f"{recorded.EXTRACTION}:d"]
    odd = spark.createDataFrame([(f"{recorded.JUDGEMENT}:a", '{"score": "high"}'), (f"{recorded.JUDGEMENT}:b", "{broken"), (f"{recorded.JUDGEMENT}:c", '{"score": 1}'), ("Other:d", '{"x": 1}')], schemas.ANSWERS)
    assert [r["key"] for r in recorded.sound(odd).orderBy("key").collect()] == ["Other:d", f"{recorded.JUDGEMENT}:c"]


# ------------------------------------------------------------------ only the shortlist is asked about


def counted(path):
    """What makes mocks that note each call in a file, as they run in other processes; and the calls so far."""
    path, judgement = str(path), recorded.JUDGEMENT

    def make():
        def handler(kind, prompt, schema):
            with open(path, "a") as f:
                f.write(schema + "\n")
            return {"is_relevant": True, "score": 0.9, "rationale": "r"} if schema == judgement else None

        return models.Mock(handler=handler)

    return make, lambda: open(path).read().split() if os.path.exists(path) else []


@pytest.fixture
def papers(spark):
    rows = [(f"p{k:02}", 1, "mesh of solids" if k < 12 else "protein folds" if k < 18 else "mesh password", "hex mesh of b-rep solids" if k < 9 else "about other things", ["A"], datetime(2026, 1, 1 + k), schemas.SEEN, None, None) for k in range(20)]
    return spark.createDataFrame(rows, PAPERS)


@pytest.mark.parametrize("fused", [False, True])
def test_a_model_judges_the_shortlist_once(spark, tmp_path, papers, fused):
    cfg = C.from_dict({"problem_statement": "hex mesh of b-rep solids", "include_keywords": ["mesh"], "exclude_keywords": ["password"], "relevance": {"embedding_threshold": 0.1, "embedding_shortlist": 4, "use_bm25_rrf": fused}})
    store, (make, calls) = Store(spark, str(tmp_path / "s")), counted(tmp_path / "calls")
    missing = [f for f in schemas.PAPERS.fields if f.name not in papers.columns]
    whole = papers.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    store.upsert("papers", whole)
    stages.Pipeline(store, cfg, now()).filter(stages.Inputs(model=make))
    assert calls() == [recorded.JUDGEMENT] * 4 and store.read("answers").count() == 4
    methods = [(r["relevance_method"], r["status"]) for r in store.read("papers").select("relevance_method", "status").collect()]
    assert methods.count(("LLM", schemas.RELEVANT)) == 4 and methods.count(("KEYWORD", schemas.IRRELEVANT)) == 8 and not any(s == schemas.SEEN for _, s in methods)
    store.upsert("papers", whole)  # all SEEN again: the answers are there
    stages.Pipeline(store, cfg, now()).filter(stages.Inputs(model=make))
    assert len(calls()) == 4
    store.upsert("papers", whole)
    given = spark.createDataFrame([(f"{recorded.JUDGEMENT}:p{k:02}", '{"score": 0.1}') for k in range(20)], schemas.ANSWERS)
    stages.Pipeline(store, cfg, now()).filter(stages.Inputs(model=make, answers=given))  # a recording goes before what was kept
    assert len(calls()) == 4 and store.read("papers").where("relevance_method = 'LLM' and status = 'IRRELEVANT'").count() == 4


def test_no_call_for_what_keywords_and_gate_exclude(spark, tmp_path, papers):
    cfg = C.from_dict({"problem_statement": "zebra", "include_keywords": ["mesh"], "exclude_keywords": ["password"], "relevance": {"embedding_threshold": 0.99}, "embedding": {"provider": "hashing"}})
    store, (make, calls) = Store(spark, str(tmp_path / "s")), counted(tmp_path / "calls")
    missing = [f for f in schemas.PAPERS.fields if f.name not in papers.columns]
    store.upsert("papers", papers.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}))
    stages.Pipeline(store, cfg, now()).filter(stages.Inputs(model=make))
    assert calls() == [] and store.read("papers").where(F.col("status") != schemas.IRRELEVANT).count() == 0


# ------------------------------------------------------------------ fetchers and embedders


PAGE = "<html><body><h2>One</h2><p>some text here</p><h2>Two</h2><p>more text</p></body></html>"
TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head>Intro</head><p>Words of it.</p></div></body></text></TEI>'


def test_html_of_the_first_page_that_has_sections():
    asked = []

    def transport(url, body, headers, timeout):
        asked.append(url)
        if len(asked) == 1:
            raise urllib.error.HTTPError(url, 404, "no", {}, None)
        return (b"<html></html>" if len(asked) == 2 else PAGE.encode())

    assert fulltext.html_request(HttpClient(transport, wait=0), {"arxiv_id": "1"}) == PAGE and asked == fulltext.html_urls("1")
    asked[:] = [0]
    assert fulltext.html_request(HttpClient(lambda *a: b"<html></html>", wait=0), {"arxiv_id": "1"}) is None


def test_pdf_to_tei():
    seen = []

    def transport(url, body, headers, timeout):
        seen.append((url, body))
        return b"%PDF bytes" if body is None else TEI.encode()

    request = fulltext.tei_request("http://service/")
    assert request(HttpClient(transport, wait=0), {"arxiv_id": "1", "pdf_url": None}) == TEI
    assert seen[0][0] == "https://arxiv.org/pdf/1" and seen[1][0] == "http://service/api/processFulltextDocument" and b"%PDF bytes" in seen[1][1]
    assert request(HttpClient(lambda url, body, *a: b"x" if body is None else b"<TEI/>", wait=0), {"arxiv_id": "1", "pdf_url": "http://p"}) is None


def test_fetched_bodies_choose_the_full_text(spark):
    cfg = C.from_dict({"extraction": {"use_grobid": True}})
    rows = spark.createDataFrame([("a", "abs"), ("b", "abs"), ("c", None)], "arxiv_id string, abstract string")
    body = lambda *r: spark.createDataFrame(list(r), "arxiv_id string, body string")
    got = {r["arxiv_id"]: (r["source"], r["sections"][0]["title"]) for r in fulltext.full_texts(rows, cfg, body(("a", TEI), ("b", "<TEI/>")), body(("a", PAGE), ("b", PAGE))).collect()}
    assert got == {"a": ("grobid", "Intro"), "b": ("html", "One"), "c": ("abstract", "Abstract")}


def test_recommended_stubs(spark):
    got = services.recommended(spark, [("http://arxiv.org/abs/2401.00001v3", " A \n title "), ("http://arxiv.org/abs/2401.00001v3", "again"), ("2401.00002", "")])
    assert {(r["arxiv_id"], r["status"]) for r in got.collect()} == {("2401.00001", schemas.SEEN), ("2401.00002", schemas.SEEN)}
    assert services.recommendations(HttpClient(lambda *a: b"not json", wait=0), ["1"]) == [] and services.recommendations(HttpClient(), []) == []


def test_embedder_choice(spark, monkeypatch):
    assert embedders.embedder(C.from_dict({"embedding": {"provider": "transformer"}})).name == "hashing"
    with pytest.raises(ValueError, match="no embedder"):
        embedders.embedder(C.from_dict({"embedding": {"provider": "transformer", "fallback_to_hashing": False}}))

    class Length:
        name = "length"

        def embed(self, df, text, vector="vector"):
            return df.withColumn(vector, F.array(F.length(text).cast("float")))

    monkeypatch.setitem(embedders.PROVIDERS, "length", lambda c: Length())
    own = embedders.embedder(C.from_dict({"embedding": {"provider": "length"}}))
    assert own.name == "length" and own.embed(spark.createDataFrame([("abc",)], "t string"), "t").first()["vector"] == [3.0]
    v = embedders.embedder(C.from_dict({"embedding": {"hashing_dim": 16}})).embed(spark.createDataFrame([("a mesh",), (None,)], "t string"), "t").collect()
    assert [len(r["vector"]) for r in v] == [16, 16] and abs(sum(x * x for x in v[0]["vector"]) - 1) < 1e-5 and set(v[1]["vector"]) == {0.0}


# ------------------------------------------------------------------ around the stages


def test_backfill_and_publish(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    item = lambda i, d, c, a: (i, i, "t", d, c, a, None, None, 1.0, [], False, schemas.NEW, "", datetime(2026, 1, 1))
    store.replace("backlog", spark.createDataFrame([item("1", "Headline results: fast\n\nApplicability to our problem: direct", "", None), item("2", "whole", "c", "a"), item("3", None, None, None)], schemas.BACKLOG))
    assert stages.backfill(store) == 1
    got = {r["id"]: (r["contributions"], r["applicability"]) for r in store.read("backlog").collect()}
    assert got["1"] == ("fast", "direct") and got["2"] == ("c", "a")
    cfg = C.from_dict({"delivery": {"output_dir": str(tmp_path / "out")}})
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "digest.md").write_text("d")
    assert stages.publish(cfg, str(tmp_path / "pages")) == ["digest.md"] and (tmp_path / "pages" / "digest.md").read_text() == "d"


def test_command_line(spark, tmp_path, capsys):
    from test_stages import ANSWER, FEED

    (tmp_path / "feed.xml").write_text(FEED)
    (tmp_path / "base.yaml").write_text("name: base\ninclude_keywords: [mesh]\nrelevance: {embedding_threshold: 0.05}\n")
    (tmp_path / "own.yaml").write_text(f"extends: base.yaml\nproblem_statement: hex mesh of b-rep solids\nstorage: {{path: {tmp_path}/store}}\nllm: {{batch_dir: {tmp_path}/batch}}\ndelivery: {{output_dir: {tmp_path}/out}}\n")
    answers = {recorded.JUDGEMENT: {"score": 0.9}, recorded.EXTRACTION: ANSWER, recorded.ESTIMATE: {"expected_impact": 0.7, "applicability": 0.6, "effort": 4.0}}
    (tmp_path / "answers.jsonl").write_text("".join(json.dumps({"key": f"{k}:2409.00001", "payload": v}) + "\n" for k, v in answers.items()))

    def go(command, *more):
        cli.main([command, "--config", str(tmp_path / "own.yaml"), *more])
        return capsys.readouterr().out

    go("init")
    assert json.loads(go("source", "--feed", str(tmp_path / "feed.xml"))) == {"source": 1}
    assert "SEEN: 1" in go("status")
    assert json.loads(go("batch-plan", "--offline")) == {"stage": "filter"}
    assert [r["key"] for r in jsonl.read_requests(spark, f"{tmp_path}/batch/requests").collect()] == [f"{recorded.JUDGEMENT}:2409.00001"]
    assert "SEEN: 1" in go("status")  # planning wrote nothing, and left no snapshot
    assert not [p.name for p in tmp_path.iterdir() if "-plan-" in p.name]
    done = json.loads(go("batch-apply", "--offline", "--answers", str(tmp_path / "answers.jsonl")))
    assert done == {"filter": 1, "extract": 1, "score": 1, "deliver": 1} and jsonl.read_requests(spark, f"{tmp_path}/batch/requests").count() == 0
    assert "SCORED: 1" in go("status") and "2409.00001" in go("backlog", "-n", "3") and go("backfill").strip() == "0"
    assert go("publish", "--to", str(tmp_path / "pages")).split() == ["backlog.md", "digest.md", "digest.html"]
