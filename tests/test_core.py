"""Operators of the core on small fixtures with known answers."""

from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import config as C
from tessera import schemas
from tessera.functions import scalars as S
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import aggregates, chunking, dedup, filters, graph, joins, rank, recorded, score

CFG = C.from_dict({"include_keywords": ["mesh", "brep"], "taxonomy_terms": ["b-rep"], "exclude_keywords": ["protein folding"], "unknown": 1, "delivery": {"top_n": 3}, "scoring": {"foundational_reserved_slots": 1}})
def now():
    return F.lit("2026-06-01 00:00:00").cast("timestamp")



def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


# ------------------------------------------------------------------ configuration


def test_merge_and_extends(tmp_path):
    assert C.merge({"a": {"b": 1, "c": [1, 2]}, "d": 1}, {"a": {"c": [3]}, "e": 2}) == {"a": {"b": 1, "c": [3]}, "d": 1, "e": 2}
    (tmp_path / "base.yaml").write_text("name: base\nscoring: {weight_impact: 2.0, weight_confidence: 0.5}\ninclude_keywords: [a]\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nname: own\nscoring: {weight_impact: 3.0}\ninclude_keywords: [b, c]\n")
    cfg = C.load(tmp_path / "own.yaml")
    assert (cfg.name, cfg.scoring.weight_impact, cfg.scoring.weight_confidence, cfg.include_keywords) == ("own", 3.0, 0.5, ("b", "c"))


# ------------------------------------------------------------------ text and numbers


@pytest.mark.parametrize(
    ("text", "term", "hit"),
    [("A cascade", "cad", False), ("CAD/CAM", "cad", True), ("we breport", "b-rep", False), ("a web report", "b-rep", True), ("mesh", "", False), ("quad  mesh", "quad mesh", False), ("c++ code", "c++", False)],
)
def test_contains_term(spark, text, term, hit):
    assert one(spark, X.contains_term(X.normalize("t"), term), t=text) is hit


def test_prefilter(spark):
    rows = [("hex mesh brep",), ("mesh protein-folding",), ("nothing",), (None,)]
    out = filters.keyword_prefilter(spark.createDataFrame(rows, "t string"), F.col("t"), CFG).collect()
    assert [(r["passed"], r["score"], r["matched"]) for r in out] == [(True, 0.6667, ["mesh", "brep"]), (False, 0.0, ["protein folding"]), (False, 0.0, []), (False, 0.0, [])]


def test_text_functions(spark):
    assert one(spark, X.strip_version("t"), t=" 2401.00001v12 ") == "2401.00001"
    assert one(spark, X.strip_version("t"), t="v2") == "v2"
    assert one(spark, F.struct(*X.id_and_version("t")), t="http://arxiv.org/abs/math/0101001v3") == ("math/0101001", 3)
    assert one(spark, F.struct(*X.id_and_version("t")), t="2401.1") == ("2401.1", 1)
    assert one(spark, X.collapse("t"), t=" a  b\x1cc\n") == "a b c"
    assert one(spark, X.shorten("t"), t="x" * 86 + " yyyyy") == "x" * 86 + "..."
    assert one(spark, X.cell("t"), t=" a|b\nc ") == "a\\|b c"
    assert one(spark, X.utc_timestamp("t"), t="2024-09-20T09:30:00Z") == datetime(2024, 9, 20, 9, 30)
    assert one(spark, X.utc_timestamp("t"), t="soon") is None
    assert one(spark, X.hash_tokens("t"), t="Hex a") == ["hex", "a", "hex_a", "c:#he", "c:hex", "c:ex#"]
    assert one(spark, X.hash_tokens("t"), t="") == []
    assert one(spark, X.words("t"), t="  ") == [] and one(spark, X.words("t"), t=" a  b") == ["a", "b"]


def test_number_functions(spark):
    days = lambda a, b: one(spark, S.age_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), a=a, b=b)
    assert days("2026-01-01 23:00:00", "2026-01-02 01:00:00") == 0
    assert days("2026-01-01 01:00:00", "2026-01-01 00:00:00") == -1
    effort = {"Small": 2, "below": 2, "L": 8, "hard work": 8, "medium": 5, "": 5, "unclear": 5, "short, high": 2}
    for cost, want in effort.items():
        assert one(spark, S.cost_effort(F.col("t")), t=cost) == want
    assert one(spark, S.clamp_effort(F.lit(float("nan")))) == 5 and one(spark, S.clamp_effort(F.lit(99))) == 10
    assert one(spark, S.citation_signal(F.lit(1000))) == 1 and one(spark, S.citation_signal(F.lit(None).cast("int"))) == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 2.0],)], "vector array<float>")
    c = V.centroid(df).first()[0]
    assert abs(c[0] - 0.6 / 3.6**0.5 * 0.5 * 2 / 1) < 0.2 and abs(sum(x * x for x in c) - 1) < 1e-9
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    out = V.hash_embed(spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "t array<string>"), "t", 16).select("vector").collect()
    want = [0.0] * 16
    for token in ("a", "b", "a", "a_b", "b_a"):
        k, sign = V.bucket(token, 16)
        want[k] += sign
    n = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / n) < 1e-6 for a, b in zip(out[0][0], want, strict=True)) and out[1][0] == [0.0] * 16


# ------------------------------------------------------------------ predicates


def test_foundational_and_recent(spark):
    rows = [(500, None, "2018-01-01"), (3, None, "2026-05-01"), (250, 60, "2026-05-01"), (None, 60, "2018-01-01"), (500, None, None), (100, 20, None)]
    df = spark.createDataFrame(rows, "c int, i int, p string").withColumn("p", F.col("p").cast("timestamp"))
    got = [r[0] for r in df.select(filters.is_foundational(F.col("c"), F.col("i"), F.col("p"), now(), CFG)).collect()]
    assert got == [True, False, True, False, False, True]
    assert [r[0] for r in df.select(filters.is_recent(F.col("p"), now(), 365)).collect()] == [False, True, True, False, True, True]


def items(spark, rows):
    base = {"status": "NEW", "foundational": False, "created_at": datetime(2026, 5, 31), "description": "", "contributions": "c", "applicability": "a", "reviewer_notes": "", "title": "t", "dependencies": [], "rationale": "", "rice": (0.1, 0.2, 0.3, 4.0)}
    full = [base | r | {"paper_id": r["id"]} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in schemas.BACKLOG.names) for r in full], schemas.BACKLOG)


def test_quota_top_k(spark):
    rows = [{"id": f"s{k}", "score": 0.5 + k / 100} for k in range(10)] + [{"id": "f", "score": 0.01, "foundational": True}, {"id": "x", "score": 9.0, "status": "ARCHIVED"}]
    df = items(spark, rows)
    assert [r["id"] for r in rank.select_top(df, CFG).collect()] == ["s9", "s8", "f"]
    none = replace(CFG, scoring=replace(CFG.scoring, foundational_reserved_slots=0))
    assert [r["id"] for r in rank.select_top(df, none).collect()] == ["s9", "s8", "s7"]
    assert [r["id"] for r in rank.plain_top(df, 2).collect()] == ["s9", "s8"]


def test_global_rank_with_ties(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(200)], "id long, v long")
    got = [r["id"] for r in rank.global_rank(df, [F.desc("v"), F.asc("id")], "r").orderBy("r").collect()]
    assert got == sorted(range(200), key=lambda k: (-(k % 5), k))
    assert rank.global_rank(df.limit(0), [F.asc("id")]).count() == 0


def test_window_and_views(spark):
    at = datetime(2026, 6, 1)
    df = items(spark, [{"id": "new", "score": 1.0, "created_at": at - timedelta(days=7)}, {"id": "old", "score": 1.0, "created_at": at - timedelta(days=7, seconds=1)}])
    assert [r["id"] for r in filters.new_in_window(df, now(), 7).collect()] == ["new"]
    old = items(spark, [{"id": "a", "score": 1.0, "contributions": " ", "applicability": "", "description": "Headline results: fast\n\nApplicability to our problem: yes"}])
    r = filters.digest_view(old).first()
    assert (r["contributions"], r["applicability"]) == ("fast", "yes")


# ------------------------------------------------------------------ joins and models


def test_enrichment(spark):
    papers = spark.createDataFrame([("p", None, None, "", ["cs"], None, "", None), ("q", 3, None, "t", [], None, "10/x", ["r"])], "arxiv_id string, citation_count int, influential_citation_count int, tldr string, fields_of_study array<string>, corpus_id string, doi string, reference_ids array<string>")
    found = spark.createDataFrame([("p", 42, 7, "short", ["cs", "math"], "9", "10/y", ["a", "a", "b"])], papers.schema)
    out = {r["arxiv_id"]: r for r in joins.enrich_citations(papers, found).collect()}
    assert out["p"]["citation_count"] == 42 and out["p"]["fields_of_study"] == ["cs", "math"] and out["p"]["reference_ids"] == ["a", "b"] and out["p"]["doi"] == "10/y"
    assert out["q"]["citation_count"] == 3 and out["q"]["doi"] == "10/x" and out["q"]["reference_ids"] == ["r"]
    more = papers.withColumns({"openalex_id": F.lit(None).cast("string"), "extra": F.lit(None).cast("map<string,string>")})
    works = spark.createDataFrame([("p", "W1", 55, ["geo"], True), ("q", "W2", 55, None, None)], "arxiv_id string, openalex_id string, cited_by_count int, labels array<string>, is_oa boolean")
    out = {r["arxiv_id"]: r for r in joins.enrich_open(more, works).collect()}
    assert out["p"]["citation_count"] == 55 and out["q"]["citation_count"] == 3 and out["p"]["extra"] == {"open_access": "true"} and out["q"]["extra"] is None


def test_quotes(spark):
    df = spark.createDataFrame([([(0, "First  part"), (1, "the FIRST\npart again")],)], "c array<struct<index:int,text:string>>")
    at = lambda q: df.select(joins.locate_quote(F.col("c"), F.lit(q))["index"]).first()[0]
    assert at("first part") == 0 and at("part AGAIN") == 1 and at("none") is None and at("  ") is None


def test_recorded_answers(spark):
    reqs = recorded.requests(spark.createDataFrame([("a", "p1"), ("b", "p2"), ("a", "p1")], "id string, p string"), recorded.JUDGEMENT, F.col("id"), F.col("p"))
    answers = spark.createDataFrame([("RelevanceJudgment:a", '{"is_relevant": false, "score": 0.8, "rationale": "x"}')], schemas.ANSWERS)
    assert [r["key"] for r in recorded.pending(reqs, answers).collect()] == ["RelevanceJudgment:b"]
    assert [(r["cache_key"], r["score"]) for r in recorded.answered(reqs, answers, recorded.JUDGEMENT).collect()] == [("a", 0.8)]
    with pytest.raises(recorded.MissingAnswer):
        recorded.answered(reqs, answers, recorded.JUDGEMENT, strict=True)
    assert one(spark, X.request_key("S", F.lit(None).cast("string"), F.lit("p"))).startswith("S:") and len(one(spark, X.request_key("S", F.lit(None).cast("string"), F.lit("p")))) == 18


def test_status_counts(spark):
    df = spark.createDataFrame([("SEEN",), ("SEEN",), ("SCORED",)], "status string")
    got = dict(aggregates.status_counts(df).collect())
    assert got["SEEN"] == 2 and got["SCORED"] == 1 and got["PARSED"] == 0 and len(got) == len(schemas.PAPER_STATUSES)


# ------------------------------------------------------------------ chunks


def sections(spark, rows):
    return spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "id string, pos int, title string, text string, page int")


def test_chunks(spark):
    w = lambda n, x="w": " ".join(f"{x}{k}" for k in range(n))
    cut = lambda rows, size, most=None: [(r["section"], r["n_words"], r["page"]) for r in chunking.chunks(sections(spark, rows), "id", size, most, ("limitation",)).orderBy("chunk_index").collect()]
    assert cut([("A", w(10), 1), ("B", w(10), 2)], 25) == [("A", 20, 1)]
    assert cut([("Big", w(100), 1)], 40) == [("Big", 40, 1), ("Big", 40, 1), ("Big", 20, 1)]
    assert cut([("A", w(10), 1), ("Limitations", w(5), 2), ("B", w(30), 3)], 25) == [("A", 10, 1), ("Limitations", 5, 2), ("B", 25, 3), ("B", 5, 3)]
    assert cut([("A", "", 1), ("Limitations", "", 2), ("", w(3), 3)], 25) == [("Limitations", 0, 2), (None, 3, 3)]
    many = [("S", w(50), k) for k in range(20)] + [("Limitations", w(7), 99)]
    got = cut(many, 40, 3)
    assert len(got) == 3 and got[-1] == ("Limitations", 7, 99) and all(n <= 40 for _, n, _ in got)


# ------------------------------------------------------------------ graphs and duplicates


def test_topological_order(spark):
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate("ABCDE")], "id string, position long")
    edges = spark.createDataFrame([("A", "B"), ("B", "E"), ("C", "D"), ("D", "C"), ("A", "Z"), ("E", "E")], "src string, dst string")
    assert [r["id"] for r in graph.topological_order(nodes, edges).orderBy("place").collect()] == ["E", "B", "A", "C", "D"]
    level = dict(graph.topological_levels(nodes.select("id"), edges).collect())
    assert level == {"E": 0, "B": 1, "A": 2, "C": None, "D": None}


def test_components(spark):
    edges = spark.createDataFrame([*[(k, k + 1) for k in range(40)], (100, 101), (102, 101), (5, 5)], "a long, b long")
    assert dict(graph.components(edges).collect()) == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def papers_for_dedup(spark):
    rows = [
        ("p1", 1, "10.1/A", None, "Hexahedral meshing of solids with learned fields", ["Ann B", "C D"], None, 5),
        ("p2", 2, " 10.1/a ", None, "Something else entirely", ["E F"], None, 9),
        ("p3", 1, "  ", None, "Hexahedral meshing of solids with learned field", ["ann  b"], None, None),
        ("p4", 1, None, "c", "Hexahedral meshing of solids with learned fields", ["Other"], None, 1),
        ("p5", 1, "", "c", "Unrelated", ["Other"], None, 1),
    ]
    return spark.createDataFrame(rows, "arxiv_id string, version int, doi string, corpus_id string, title string, authors array<string>, published timestamp, citation_count int")


def test_dedupe(spark):
    p = papers_for_dedup(spark)
    assert {tuple(r) for r in dedup.fuzzy_edges(p, 0.9).collect()} == {("p1", "p3")}
    assert dict(dedup.clusters(p, 0.9).collect()) == {"p1": "p1", "p2": "p1", "p3": "p1", "p4": "p4", "p5": "p4"}
    backlog = items(spark, [{"id": f"p{k}", "score": 1.0} for k in range(1, 6)])
    out, pairs = dedup.dedupe_backlog(backlog, p, 0.9)
    assert {tuple(r) for r in pairs.collect()} == {("p2", "p1"), ("p2", "p3"), ("p4", "p5")}
    assert {r["id"] for r in out.where("status = 'ARCHIVED'").collect()} == {"p1", "p3", "p5"}


def test_edges(spark):
    df = spark.createDataFrame([("p", [" a ", "a", "p", "", None, "b"], ["b", "b"])], "arxiv_id string, r array<string>, d array<string>")
    got = {tuple(r)[:3] for r in graph.dependency_edges(df, F.col("r"), F.col("d")).collect()}
    assert got == {("p", "a", "citation"), ("p", "b", "citation"), ("p", "b", "extracted")}


# ------------------------------------------------------------------ scoring


def test_items(spark):
    cfg = C.from_dict({"scoring": {"emit_secondary_items": True, "weight_impact": 2.0}})
    e = dict.fromkeys(schemas.EXTRACTIONS.names) | {"paper_id": "p", "method_summary": "A method", "headline_results": " wins ", "claimed_advantages": ["short", "a method", "Runs on one thin laptop without a GPU"], "code_link": "http://x", "provenance": {"method_summary": None}, "extraction_confidence": 0.8, "dependencies_on_other_methods": ["d"]}
    df = spark.createDataFrame([("p", "T", None, [], 0, None, tuple(e.values()))], f"arxiv_id string, title string, published timestamp, code_links array<string>, citation_count int, influential_citation_count int, extraction struct<{schemas.EXTRACTIONS.simpleString()[7:-1]}>")
    estimates = spark.createDataFrame([("p", 0.7, 0.6, 4.0, "why", "")], "paper_id string, expected_impact double, applicability double, effort double, impact_rationale string, effort_rationale string")
    out = score.rice(score.estimate(score.signals(df, now(), cfg), cfg, estimates), cfg)
    got = {r["id"]: r for r in score.backlog_items(out, now(), cfg).collect()}
    conf = 0.2 + 0.35 / 4 + 0.25 * 0.8 + 0.2 * 0.5
    assert abs(got["p#1"]["rice"]["confidence"] - conf) < 1e-9 and got["p#1"]["rice"]["expected_impact"] == 1.0
    assert abs(got["p#1"]["score"] - 0.6 * conf / 4) < 1e-9
    assert got["p#1"]["contributions"] == "A method Headline results: wins" and got["p#1"]["title"] == "A method"
    assert got["p#2"]["title"] == "Runs on one thin laptop without a GPU" and abs(got["p#2"]["rice"]["applicability"] - 0.48) < 1e-9
    assert "Impact 1.00 (why)" in got["p#1"]["rationale"] and "(n/a)" in got["p#1"]["rationale"]
