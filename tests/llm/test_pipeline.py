"""The pipeline, stage by stage, and the registered queries."""

import random
from collections import Counter

import pytest

from oracle import DATA, same
from tessera.llm import mixing, queries
from test_dedup import plain_near, words
from test_text import INSULTS, check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to") for b in ("n", "ra", "ts", "vel", "do", "pi")]
    rows, labels = [], []
    for k in range(360):
        w = [rng.choice(vocab) for _ in range(rng.randrange(8, 70))]
        if k % 6 == 0:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        rows.append([k, " ".join(w), "en", f"src{rng.randrange(4)}", 0])
        labels.append((k, 1, int(k % 6 == 0)))
    for k in range(360, 400):
        text = rows[k - 350][1]
        rows.append([k, text.replace(" ", "\n", 2) if k % 2 else f"{text} {rng.choice(vocab)}", "en", "hot", 0])
    rows += [[400, None, None, None, 0], [401, "", "en", "src1", 0], rows[5], [402, rows[7][1], "en", None, 0]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = [tuple(r) for r in after.collect()]
        if name != "packing":
            assert after.columns == docs.columns and set(rows) <= set(kept)
        if name == "toxicity":
            gone = set(kept) - set(rows)
            bad = {r for r in kept if any(w in INSULTS for w in words(r[1]))}
            assert len(gone ^ bad) <= 0.03 * len(kept)
        elif name == "exact_dedup":
            plain = lambda t: "".join(words(t))
            assert Counter(plain(r[1]) for r in rows) == {plain(r[1]): 1 for r in kept}
        elif name == "near_dedup":
            want = {r[0] for r in plain_near(kept) if r[3]}
            assert sorted(r[0] for r in rows) == sorted(want) and len(rows) < len(kept)
        elif name == "mixing":
            plan = {(r["doc_id"], r["text"]): r["mix_times"] for r in mixing.mix_plan(docs).collect()}
            assert Counter((r[0], r[1]) for r in rows) == {k: n for k, n in plan.items() if n}
        else:
            check_packing(kept, after.collect(), 0.05)
        docs, kept = after, rows
    run = corpus_pipeline.run(spark, folder)
    assert run.columns == docs.columns and sorted(map(tuple, run.collect())) == sorted(kept)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    same(spark, name, queries.queries(), queries.oracle_sql())
