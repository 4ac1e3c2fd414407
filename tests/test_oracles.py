"""Every registered core query against its SQL, and the others for their rows."""

import pytest

from oracle import DATA, same
from tessera.plans import registry

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    same(spark, name, registry.queries(), registry.oracle_sql())


def test_html_sections(spark):
    from tessera.sources.html import html_sections

    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = sorted((p["page_id"], k, *s) for p in pages for k, s in enumerate(html_sections(p["html"])))
    assert sorted(tuple(r) for r in registry.queries()["txt_html_sections"](spark, str(DATA)).collect()) == want


def test_hash_embedding(spark):
    import math
    import re

    from tessera.functions.vectors import bucket

    rows = {r["doc_id"]: r["vector"] for r in registry.queries()["vec_hash_embed"](spark, str(DATA)).collect()}
    for doc in spark.read.parquet(f"{DATA}/documents.parquet").limit(20).collect():
        w = re.findall("[a-z0-9]+", doc["text"].lower())
        grams = [*w, *(f"{a}_{b}" for a, b in zip(w, w[1:], strict=False)), *(f"c:{p[k:k + 3]}" for p in (f"#{x}#" for x in w if len(x) > 2) for k in range(len(p) - 2))]
        v = [0.0] * 256
        for g in grams:
            k, s = bucket(g, 256)
            v[k] += s
        n = max(math.sqrt(sum(x * x for x in v)), 1e-12)
        assert all(abs(a - b / n) < 2e-6 for a, b in zip(rows[doc["doc_id"]], v, strict=True))


def test_fuzzy_pairs_miss_nothing(spark):
    import difflib
    import re
    from itertools import combinations

    from tessera.plans.standin import typed_papers

    rows = [(r["doc_id"], " ".join(re.findall("[a-z0-9]+", r["title"].lower())), set(r["authors"])) for r in typed_papers(spark, str(DATA)).select("doc_id", "title", "authors").collect()]
    want = set()
    for (a, t, x), (b, u, y) in combinations(sorted(rows, key=lambda r: r[0]), 2):
        if t and u and t.split()[0] == u.split()[0] and x & y and difflib.SequenceMatcher(None, t, u).ratio() >= 0.9:
            want.add((a, b))
    assert {tuple(r) for r in registry.queries()["dedup_fuzzy"](spark, str(DATA)).collect()} == want


def test_rendered_rows(spark):
    rows = registry.queries()["render_backlog_rows"](spark, str(DATA)).collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 25
    assert all(r["line"].startswith(f"| {r['place']} | 0.") and r["line"].count(" | ") == 9 for r in rows)
