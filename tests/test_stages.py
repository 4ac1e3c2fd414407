"""Sources, the store, the stages end to end, and the driver contract."""

import json
import urllib.error
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera import config as C
from tessera import schemas
from tessera.operators import recorded
from tessera.plans import stages
from tessera.plans.render import backlog_markdown, digest
from tessera.sources import atom, html, jsonl, services
from tessera.sources.http import HttpClient
from tessera.sources.store import Store
from tessera.streaming import harvest

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2409.00001v2</id><updated>2024-09-21T00:00:00Z</updated><published>2024-09-20T09:30:00Z</published><title>Hex mesh
 generation</title><summary> A mesh of B-rep solids. </summary><author><name>Ann B</name></author><author><name>C D</name></author><arxiv:doi>10.1/x</arxiv:doi>
<link href="http://arxiv.org/abs/2409.00001v2" rel="alternate" type="text/html"/><link title="pdf" href="http://arxiv.org/pdf/2409.00001v2" rel="related"/><category term="cs.LG"/><category term="cs.LG"/><category term="cs.CG"/></entry>
<entry><id>http://arxiv.org/abs/2409.00002v1</id><published>2024-09-19T00:00:00Z</published><title>Protein</title><summary>None of it</summary><author><name>E</name></author></entry>
</feed>"""
def now():
    return F.lit("2026-06-01 00:00:00").cast("timestamp")



def test_atom(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    from_files = {r["arxiv_id"]: r.asDict() for r in atom.read_files(spark, str(tmp_path / "feed.xml")).collect()}
    parsed = {r["arxiv_id"]: r.asDict() for r in atom.papers(spark.createDataFrame(atom.parse(FEED), atom.RECORD)).collect()}
    assert from_files == parsed
    p = parsed["2409.00001"]
    assert (p["version"], p["title"], p["doi"], p["categories"]) == (2, "Hex mesh generation", "10.1/x", ["cs.LG", "cs.CG"])
    assert p["authors"] == ["Ann B", "C D"] and p["published"] == datetime(2024, 9, 20, 9, 30) and p["pdf_url"].endswith("2409.00001v2")
    assert parsed["2409.00002"]["pdf_url"] == "http://arxiv.org/pdf/2409.00002" and parsed["2409.00002"]["doi"] is None


def test_paged_harvest():
    asked = []

    def transport(url, body, headers, timeout):
        asked.append(url)
        return FEED.encode()

    http = HttpClient(transport, wait=0)
    assert len(list(atom.harvest("cat:x", None, 10, page=2, client=http))) == 10 and len(asked) == 5
    assert len(list(atom.harvest("cat:x", datetime(2024, 9, 20, tzinfo=UTC), 3, page=3, client=http))) == 1

    def down(*_):
        raise OSError("down")

    with pytest.raises(OSError):
        list(atom.harvest("cat:x", None, 3, client=HttpClient(down, wait=0)))


def test_http_retries():
    tries = []

    def flaky(url, body, headers, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise TimeoutError
        return b'{"a": 1}'

    assert HttpClient(flaky, wait=0).get_json("http://x", params={"q": "a b"}) == {"a": 1} and tries[0] == "http://x?q=a+b"

    def refused(url, *_):
        tries.append(url)
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    tries.clear()
    with pytest.raises(urllib.error.HTTPError):
        HttpClient(refused, wait=0).get_text("http://x")
    assert len(tries) == 1 and not HttpClient(refused, wait=0).alive("http://x") and HttpClient(lambda *a: b"", wait=0).alive("http://x")


def test_sections():
    page = "<head><title>x</title></head>lead<h1>One <b>two</b></h1><p>a</p><p>b</p><script>no</script><h2></h2>c<br/>d<h4>kept</h4><h3>End</h3>"
    assert html.html_sections(page) == [("", "lead"), ("One two", "a b"), ("", "c d kept"), ("End", "")]
    assert html.html_sections(None) == [] and html.html_sections("<p>a &amp; b") == [("", "a & b")]
    tei = '<TEI xmlns="http://x"><text><body><div><head>Intro</head><p>one</p><p>two <ref>[1]</ref></p></div><div/></body></text></TEI>'
    assert html.tei_sections(tei) == [("Intro", "one two [1]")] and html.tei_sections("<broken") == []


def test_services(spark):
    body = json.dumps({"citationCount": 42, "influentialCitationCount": 7, "tldr": {"text": "t"}, "fieldsOfStudy": ["CS"], "externalIds": {"CorpusId": 5, "DOI": "d"}, "references": [{"externalIds": {"ArXiv": "1506.03134"}}, {"externalIds": {"CorpusId": 222}}, {"externalIds": None}]})
    r = services.citations(spark.createDataFrame([("p", body)], "arxiv_id string, body string")).first()
    assert (r["citation_count"], r["corpus_id"], r["reference_ids"]) == (42, "5", ["1506.03134", "CorpusId:222"])
    work = json.dumps({"id": "W", "cited_by_count": 55, "open_access": {"is_oa": True}, "topics": [{"display_name": "T"}], "concepts": [{"display_name": "T"}, {"display_name": "C"}, {}]})
    r = services.open_works(spark.createDataFrame([("p", work)], "arxiv_id string, body string")).first()
    assert (r["openalex_id"], r["labels"], r["is_oa"]) == ("W", ["T", "C"], True)

    def by_title(url, *_):
        return b'{"results": [{"id": "W2"}]}' if "filter" in url else b"{}"

    assert json.loads(services.open_request(HttpClient(by_title), {"doi": "https://doi.org/10/x", "title": "t"}))["id"] == "W2"
    assert services.recommendations(HttpClient(lambda *a: b'{"recommendedPapers": [{"title": "a", "externalIds": {"ArXiv": "1"}}, {}]}'), ["2"]) == [("1", "a")]
    fetched = services.fetch(spark.createDataFrame([("a",), ("b",)], "arxiv_id string"), lambda http, row: None if row["arxiv_id"] == "b" else "x")
    assert [tuple(r) for r in fetched.collect()] == [("a", "x")]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "k", "payload": {"score": 0.1}}\nbroken\n{"key": "k", "payload": {"score": 0.9}}\n{"key": "z", "payload": {}}\n')
    got = dict(jsonl.read_answers(spark, str(tmp_path / "a.jsonl")).collect())
    assert json.loads(got["k"]) == {"score": 0.9} and got.keys() == {"k", "z"}
    reqs = spark.createDataFrame([("k", "S", "p")], "key string, schema string, prompt string")
    jsonl.write_requests(reqs, str(tmp_path / "r"))
    assert jsonl.read_requests(spark, str(tmp_path / "r")).collect() == reqs.collect()
    jsonl.append_answers(spark.createDataFrame([("n", '{"score":1}')], schemas.ANSWERS), str(tmp_path / "w"))
    assert dict(jsonl.read_answers(spark, str(tmp_path / "w")).collect()) == {"n": '{"score":1}'}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), {"t": schemas.table("k string, v int, created_at timestamp"), "state": schemas.STATE}, {"t": ["k"], "state": ["key"]})
    rows = lambda *r: spark.createDataFrame([(k, v, datetime(2026, 1, d)) for k, v, d in r], "k string, v int, created_at timestamp")
    assert s.read("t").count() == 0
    s.upsert("t", rows(("a", 1, 1), ("b", 2, 1)), keep=("created_at",))
    s.upsert("t", rows(("a", 9, 5), ("c", 3, 5)), keep=("created_at",))
    got = {r["k"]: (r["v"], r["created_at"].day) for r in s.read("t").collect()}
    assert got == {"a": (9, 1), "b": (2, 1), "c": (3, 5)}
    s.insert_new("t", rows(("a", 0, 9), ("d", 4, 9), ("d", 4, 9)))
    assert {r["k"]: r["v"] for r in s.read("t").collect()} == {"a": 9, "b": 2, "c": 3, "d": 4}
    s.put_state("x", "1")
    s.put_state("x", "2")
    assert s.get_state("x") == "2" and s.get_state("y") is None


ANSWER = {
    "problem_addressed": "Meshing", "method_summary": "A mesh method", "key_architecture_choices": [], "datasets": [], "metrics": [], "headline_results": "wins", "claimed_advantages": [], "limitations": [],
    "applicability_to_our_problem": "direct", "implementation_cost_estimate": "S", "dependencies_on_other_methods": ["2409.00009"], "contributions_summary": "", "reviewer_notes": "", "code_link": "",
    "provenance_quotes": {"method_summary": "mesh of b-rep", "headline_results": "not there"}, "extraction_confidence": 0.8,
}


@pytest.fixture
def world(spark, tmp_path):
    cfg = C.from_dict({"name": "w", "problem_statement": "hex mesh of b-rep solids", "include_keywords": ["mesh"], "relevance": {"embedding_threshold": 0.05}, "delivery": {"output_dir": str(tmp_path / "out")}})
    harvested = atom.papers(spark.createDataFrame(atom.parse(FEED), atom.RECORD))
    keys = {recorded.JUDGEMENT: {"is_relevant": True, "score": 0.9, "rationale": "fits"}, recorded.EXTRACTION: ANSWER, recorded.ESTIMATE: {"expected_impact": 0.7, "applicability": 0.6, "effort": 4.0, "impact_rationale": "", "effort_rationale": ""}}
    answers = spark.createDataFrame([(f"{k}:2409.00001", json.dumps(v)) for k, v in keys.items()], schemas.ANSWERS)
    return Store(spark, str(tmp_path / "store")), cfg, harvested, answers


def test_all_stages_and_again(spark, world, tmp_path):
    store, cfg, harvested, answers = world
    done = stages.Pipeline(store, cfg, now(), strict=True).run(stages.Inputs(harvested, answers=answers))
    assert done == {"source": 1, "filter": 1, "extract": 1, "score": 1, "deliver": 1}
    p = store.read("papers").first()
    assert (p["arxiv_id"], p["status"], p["relevance_method"], p["relevance_score"]) == ("2409.00001", schemas.SCORED, "LLM", 0.9)
    e = store.read("extractions").first()
    assert e["provenance"]["method_summary"]["chunk_index"] == 0 and e["provenance"]["headline_results"]["chunk_index"] is None
    assert {tuple(r)[:3] for r in store.read("dependencies").collect()} == {("2409.00001", "2409.00009", "extracted")}
    assert store.get_state(harvest.CURSOR).startswith("2024-09-20 09:30")
    made = store.read("backlog").collect()
    again = stages.Pipeline(store, cfg, now(), strict=True).run(stages.Inputs(harvested, answers=answers))
    assert (again["source"], again["score"]) == (0, 0) and store.read("backlog").collect() == made
    text = (tmp_path / "out" / "backlog.md").read_text()
    assert "| 1 | 0." in text and "No foundational items" in text and "[2409.00001](https://arxiv.org/abs/2409.00001)" in text
    assert "**1** new backlog item(s)" in (tmp_path / "out" / "digest.md").read_text() and (tmp_path / "out" / "digest.html").exists()


def test_plan_then_apply(spark, world, tmp_path):
    store, cfg, harvested, answers = world
    stages.Pipeline(store, cfg, now()).run(stages.Inputs(harvested), ("source",))
    for k, name in enumerate((recorded.JUDGEMENT, recorded.EXTRACTION, recorded.ESTIMATE, None)):
        known = answers.limit(0) if k == 0 else answers.where(F.split("key", ":")[0].isin([recorded.JUDGEMENT, recorded.EXTRACTION, recorded.ESTIMATE][:k]))
        scratch = store.snapshot(str(tmp_path / f"plan{k}"))
        stage, reqs = stages.plan(stages.Pipeline(scratch, cfg, now()), stages.Inputs(answers=known))
        if name is None:
            assert (stage, reqs) == ("ready", None)
        else:
            assert [r["schema"] for r in reqs.collect()] == [name]
    assert store.read("papers").first()["status"] == schemas.SEEN
    with pytest.raises(recorded.MissingAnswer):
        stages.Pipeline(store, cfg, now(), strict=True).run(stages.Inputs(answers=answers.limit(0)), ("filter",))


def test_digest_of_nothing(spark):
    cfg = C.from_dict({"name": "<n>"})
    empty = spark.createDataFrame([], schemas.BACKLOG)
    d = digest(empty, now(), cfg, 0)
    assert d["window"] == 7 and "_No new items in this window._" in d["markdown"] and "&lt;n&gt;" in d["html"]
    assert "_0 item(s) shown" in backlog_markdown(empty, cfg)


def test_stream_takes_each_file_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = "arxiv_id string, title string, abstract string, published timestamp"
    rows = lambda *ids: spark.createDataFrame([(i, "t", "a", datetime(2026, 1, d)) for i, d in ids], schema)
    go = lambda: harvest.run(spark, store, str(tmp_path / "in"), schema, str(tmp_path / "cp"))
    rows(("a", 1), ("b", 2), ("a", 1)).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    rows(("b", 2), ("c", 3), ("late", 1)).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    go()
    assert {r["arxiv_id"] for r in store.read("papers").collect()} == {"a", "b", "c"}
    assert store.get_state(harvest.CURSOR).startswith("2026-01-03")


def test_no_violations(spark):
    for name, condition in schemas.violations().items():
        table = name.split(".")[0]
        assert spark.createDataFrame([], schemas.TABLES[table]).where(condition).count() == 0
    bad = spark.createDataFrame([(2.0,)], "relevance_score double")
    assert bad.where(schemas.violations()["papers.relevance_score"]).count() == 1


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert entry.entry(spark).columns == ["doc_id", "passed", "score", "matched"]
