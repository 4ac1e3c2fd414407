import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, score double, kept boolean, comp long, _m_size long, mix_size long, n_lines string, _ld_id long, _k1 long, row long, bucket int"
VOCAB = [a + b for a in ("ta", "re", "mi", "zo", "Ka", "ü", "é") for b in ("n", "ll", "st", "x.", "r,", "que", "")]


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, ties, repeated rows, copies and near copies, and clashing columns."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    rows = []
    base = [say(n) for n in (40, 60, 80, 120, 30, 25, 200, 14, 13, 12, 5, 4, 3, 1)]
    passage = "\n".join(say(7) for _ in range(4))
    for k in range(90):
        t = base[k % len(base)]
        if k % 5 == 1:
            words = t.split(" ")
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        if k % 7 == 2:
            t = say(10) + "\n" + passage + "\n" + say(15)
        if k % 11 == 3:
            t = t.replace(" ", "\t \n", 3)
        rows.append([k, t, rng.choice(["en", "de"]), rng.choice(["src1", "src10", "src2", "hot", "hot", "hot", None])])
    rows += [[100, None, None, None], [101, "", "en", "hot"], [102, " \n\t", "en", "hot"], [103, say(6000), "en", "long"], [None, base[0], "en", "hot"]]
    rows += [rows[3], rows[3], [104, base[0].upper(), "en", "src2"], [105, "a\x0bb\x0cc\x1cd\xa0e " + base[1], "en", "src2"], [106, "one\n\n\n\n\n\ntwo\n\n\n\n", "en", "hot"]]
    return [(*r, len(r[1] or ""), 1, 2, 3.0, True, 4, 5, 6, "seven", 8, 9, 10, 11) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
