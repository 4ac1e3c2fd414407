"""Language-model scoring, chat formatting, packing, mixing, toxicity and GIF against plain versions and round trips."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, gif, lm, mixing, packing, toxicity
from tessera.llm.queries import public_tokenizer

LOW = {c: c + 32 for c in range(65, 91)}
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

# ------------------------------------------------------------------ language model


def test_lm_counts_and_gain(spark, docs, corpus, nothing):
    out = lm.score_texts(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*words((t or "").translate(LOW)), None]
    count = Counter(w for r in corpus if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in corpus:
        t = tokens(r[1])
        want[r[0], held(r[0]), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in out) == want
    assert sum(r["score"] - r["base_score"] for r in out) > 0
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm.score_texts(nothing).count() == 0


def test_lm_only_held_out(spark):
    own = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2]
    out = lm.score_texts(spark.createDataFrame([(k, "a b c") for k in own], "doc_id long, text string")).collect()
    assert len(out) == len(own) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in out)


def plain_shape(word):
    raw = word.encode()
    beyond = next((k for k, b in enumerate(raw) if b > 127), None)
    script = 0 if beyond is None else 1 + ((raw[beyond] << 8 | raw[beyond + 1]) * 2654435761 >> 8) % 4
    ending = 0 if raw[-1] > 127 or chr(raw[-1]).isalpha() else 1 if raw[-1] == 46 else 2
    return (script * 3 + ending) * 2 + (len(raw) > 6)


@given(st.lists(st.text(alphabet="aZz[@.,9é日ß!", min_size=1, max_size=9), max_size=8))
def test_shapes(some):
    assert lm.shapes_of(pa.array(some, pa.large_string())).tolist() == [plain_shape(w) for w in some]


def plain_score(model, count, text):
    """The probability of a text by the definition: sums of weights, word by word."""
    h = lambda w: int(lm.hash_words(pa.array([w]))[0][0]) if w is not None else lm.END
    tokens = [*words(text.translate(LOW)), None]
    ids = [h(w) >> 32 for w in tokens]
    shapes = [plain_shape(w) if w is not None else lm.SHAPES for w in tokens]
    cells = [int(model.cells(np.array([h(w)], np.uint64), np.array([s]))[0]) for w, s in zip(tokens, shapes, strict=True)]
    m64 = 2**64 - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & m64
        return x ^ x >> 33

    odd, total = 0x9E3779B97F4A7C15, 0.0
    for i, w in enumerate(tokens):
        one, two, three = (ids[i - k] if i >= k else lm.START for k in (1, 2, 3))
        before = cells[i - 1] if i else lm.CELLS
        keys = [mix(x + k * odd & m64) for k, x in enumerate((before, one, two, one * odd + two, one * odd + three), 1)]
        c, s = divmod(cells[i], lm.SLOTS)
        first = [0, *(1 + ((k >> 32) * (lm.ROWS - 1) >> 32) for k in keys)]
        turned = [((k ^ (c + 1) * 0xD6E8FEB86659FD93 & m64) * odd) & m64 for k in keys]
        second = [c, *(lm.CLASSES + ((k >> 32) * (lm.ROWS - lm.CLASSES) >> 32) for k in turned)]
        for rows, table, label in ((first, model.weights[0], c), (second, model.weights[1], s)):
            x = [sum(float(table[r][j]) for r in rows) for j in range(table.shape[1])]
            total += (x[label] - math.log(sum(map(math.exp, x)))) / math.log(10)
        total += math.log10((count[w] + 1) / (model.cell_tokens[cells[i]] + model.cell_distinct[cells[i]] + 1))
    return total


def test_lm_score_is_the_models(spark):
    rng = np.random.default_rng(2)
    follow = {w: rng.choice(30, 3) for w in range(30)}
    rows = []
    for k in range(300):
        w = [int(rng.integers(30))]
        while len(w) < 25:
            w.append(int(rng.choice(follow[w[-1]])))
        rows.append((k, " ".join(f"wo{x}" for x in w)))
    rows += [(900, None), (901, "never seen É Wo1"), (902, "")]
    grouped = lm._grouped(spark.createDataFrame(rows, "doc_id long, text string"))
    model, counts = lm.fit(grouped)
    out = {r["doc_id"]: r for r in lm._scored(grouped, counts, model).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for k, t in rows if not held(k) for w in [*words((t or "").translate(LOW)), None])
    for k, t in [*rows[:25], *rows[-3:]]:
        assert abs(out[k]["score"] - plain_score(model, count, t or "")) < 1e-3
    # word pairs are learned: each word has three followers of thirty
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in out.values() if r["held_out"] and r["n_tokens"] > 20]
    assert len(gain) > 20 and sum(gain) / len(gain) > 0.4


def test_gradient_is_what_was_seen_less_what_was_expected():
    rng = np.random.default_rng(3)
    weights = tuple(rng.normal(size=(lm.ROWS, n)).astype(np.float32) / 4 for n in (lm.CLASSES, lm.SLOTS))
    words, cells, size = rng.integers(0, 9, 40).astype(np.uint64), rng.integers(0, lm.CELLS, 40), np.array([25, 15])
    sums = [[np.zeros((lm.ROWS, n), np.int64), np.zeros((n, lm.ROWS))] for n in (lm.CLASSES, lm.SLOTS)]
    lm.gradient(words, cells, size, weights, sums)
    rows = lm.feature_rows(words, cells, size)
    for t in (0, 1):
        for r in (0, 7, int(rows[t][3][5]), int(rows[t][5][30])):
            at, bump = int(cells[30] // lm.SLOTS if t == 0 else cells[30] % lm.SLOTS), 1e-2
            more, less = ([w.copy() for w in weights] for _ in range(2))
            more[t][r, at] += bump
            less[t][r, at] -= bump
            slope = (lm.token_logs(words, cells, size, more).sum() - lm.token_logs(words, cells, size, less).sum()) / (2 * bump)
            seen, expected = sums[t]
            assert abs(slope - (seen[r, at] - expected[at, r])) < 0.02


def test_softmax_sums_to_one():
    weights = np.random.default_rng(0).normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(lm.log_shares(np.random.default_rng(1).integers(0, lm.ROWS, (6, 500)), weights)).sum(axis=1), 1, atol=1e-4)


# ------------------------------------------------------------------ chat


texts = st.text(alphabet=st.sampled_from(list("<>/[]\\sINSTYROLE a\n|é{%}")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>", "[IS]\\"]), texts), max_size=6))
def test_chat_round_trip(turns):
    r = chat.Template().render([{"role": a, "content": b} for a, b in turns])
    assert chat.read_back(r.text()) == turns
    learned = "".join(chat.unescape(r.text()[a:b]) for a, b in r.spans())
    assert learned == "".join(b for a, b in turns if a == "assistant")


def test_gif_of_a_huge_screen():
    """A few bytes that declare gigabytes are malformed, and are found to be so before anything is allocated."""
    palette = np.zeros((4, 3), np.uint8)
    small = gif.encode([gif.Frame(0, 0, 4, 4, bytes(16), palette, -1, 0, 0)], 4, 4, palette)
    screen, frame = bytearray(small), bytearray(small)
    screen[6:10] = b"\xff\xff\xff\xff"
    at = small.index(b"\x2c")
    frame[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    for data in (screen, frame):
        with pytest.raises(ValueError):
            gif.decode(bytes(data))
    large = gif.encode([gif.Frame(0, 0, 3000, 2000, bytes(6_000_000), palette, -1, 0, 0)], 3000, 2000, palette)
    assert next(gif.canvases(gif.decode(large)))[1].shape == (2000, 3000, 4)


@given(texts)
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not chat._MARK.search(out)


def test_template_language():
    t = lambda s, **k: chat.Template(s).render([], **k).text()
    assert t("{% for x in xs %}{{ loop.index }}{{ x | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["a", "b"]) == "1A,2B"
    assert t("{% set a = 'x' ~ 1 %}{{ a }}{% if 1 < 2 and 'b' in 'abc' %}y{% else %}n{% endif %}{{ d['k'].z }}{{ d.none }}", d={"k": {"z": 3}}) == "x1y3"
    assert t("a  {#- c -#}  {{- 'b' -}}  c\n") == "abc\n"
    assert chat.Template("{{ 'a' + 'b' }}{% if false %}x{% elif true %}y{% else %}z{% endif %}").tree == [chat.Out(chat.Const("aby"))]
    for bad in ("{{ x", "{% for x %}{% endfor %}", "{{ x | open }}", "{% if x %}", "{{ f(1) }}", "{% endif %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


@pytest.mark.parametrize("source", ["{{ 1 < 'a' }}", "{{ x < 1 }}", "{{ 1 >= x }}", "{{ x | length }}", "{{ 3 | length }}", "{{ x + 1 }}", "{{ xs < 1 }}", "{{ 1 in xs and d < d }}", "{{ 'a' | length | length }}"])
def test_operations_on_wrong_kinds(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source).render([], xs=[1], d={}).text()


def test_comparisons_and_lengths_that_hold():
    t = lambda s, **k: chat.Template(s).render([], **k).text()
    assert t("{{ 'a' < 'b' }}{{ 2 >= 2 }}{{ x == 1 }}{{ 'é' | length }}{{ xs | length }}{{ d | length }}", xs=[1, 2], d={"k": 1}) == "truetruefalse121"


def test_chat_query(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", "</s>"), (None, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", None), (2, None, "system", "é")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    want = {1: [("user", "</s>"), ("assistant", "hi")], None: [("", "")], 2: [("system", "é"), ("user", "x"), ("user", "x"), ("assistant", "")]}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


# ------------------------------------------------------------------ packing


def check_packing(rows, pieces, slack):
    ids = packing.Ids(public_tokenizer())
    whole = {}
    for r in rows:
        whole[r[0], r[1] or ""] = np.append(ids.whole(r[1] or ""), np.int32(packing.END))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    padded = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert own[0]["offset"] == 0 and all(b["offset"] == a["offset"] + a["length"] for a, b in pairwise(own))
        size = own[-1]["offset"] + own[-1]["length"]
        assert size <= packing.WINDOW
        padded += 0 if size & (size - 1) == 0 else packing.WINDOW - size
        total += size
    copies = Counter((r[0], len(whole[r[0], r[1] or ""])) for r in rows)
    assert total == sum(len(whole[r[0], r[1] or ""]) for r in rows)
    for key, own in by_doc.items():
        spans = Counter()
        for p in own:
            spans[p["start"]] += 1
            spans[p["start"] + p["length"]] -= 1
        assert spans[0] == copies[key] == -spans[key[1]] and all(v == 0 for k, v in spans.items() if k not in (0, key[1]))
        texts = [whole[r[0], r[1] or ""] for r in rows if r[0] == key[0] and len(whole[r[0], r[1] or ""]) == key[1]]
        for p in own:
            assert p["ids_crc32"] in {zlib.crc32(t[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes()) for t in texts}
    assert padded <= slack * total + packing.WINDOW * 4


def test_packing(docs, corpus, nothing):
    check_packing(corpus, packing.pack(docs, public_tokenizer()).collect(), 0.05)
    assert packing.pack(nothing, public_tokenizer()).count() == 0
    with_ids = packing.pack(docs.limit(5), public_tokenizer(), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


def test_word_tables_spell_like_whole_texts():
    ids = packing.Ids(public_tokenizer())
    rows = ["É<|endoftext|>x", None, "don't á é ΣΑΣ it's", " x　y <|ENDOFTEXT|>", "", "A\x1cb c \u0085d", "a <|startoftext|>", "x1y22 <|endoftext|> z"]
    got, n, _, _, _ = packing.texts_to_ids(ids, [pa.array(rows[:3]), pa.array(rows[3:])])
    want = [np.append(ids.whole(t or ""), 1) for t in rows]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == np.concatenate(want).tolist()


def test_neighbours_share_words():
    codes = np.array([0, 1, 2, 3, 3, 4, 1, 2, 5, 6, 7, 7])
    index = packing.Index(codes, np.array([3, 3, 3, 3]), 8)
    assert index.neighbours(0, np.array([True, False, False, False])).tolist() == [2]
    assert index.neighbours(3, np.zeros(4, bool)).tolist() == [] and index.neighbours(0, np.ones(4, bool)).tolist() == []


def together(pieces):
    by_sequence = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        by_sequence[sequence].add(doc)
    return by_sequence


def test_copies_do_not_hide_neighbours():
    # 21 copies of one text (0-20), one unrelated longer text (21), one text that shares a word with the copies (22)
    texts = [[*range(14)], [*range(20, 40)], [13, 50]]
    twins = np.array([0] * 21 + [1, 2])
    index = packing.Index(np.array([w for t in texts for w in t]), np.array([len(t) for t in texts]), 60)
    by_sequence = together(packing.pack_shard(np.array([60] * 21 + [50, 40]), index, 100, twins))
    assert by_sequence[0] == {0, 22}


def test_copies_do_not_hide_neighbours_in_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "partitions", lambda *_: 1)
    say = lambda stem, n: " ".join(f"{stem}{chr(97 + k)}" for k in range(n))
    texts = [say("grove", 20) + " lantern"] * 21 + [say("pixel", 10)] * 3 + ["lantern " + say("mossy", 4)]
    ids = packing.Ids(public_tokenizer())
    size = [len(ids.whole(t)) + 1 for t in texts]
    assert size[0] > size[21] and size[0] > size[24]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df, public_tokenizer(), size[0] + size[24]).collect()
    assert {p["doc_id"] for p in pieces if p["sequence_id"] == 0} == {0, 24}


def plain_bm25(texts, doc, used):
    """Scores of all unused documents for every word of ``doc``, by the definition."""
    mean, df = sum(map(len, texts)) / len(texts), Counter(w for t in texts for w in set(t))
    out = {}
    for k, t in enumerate(texts):
        if k != doc and not used[k]:
            tf = Counter(t)
            score = sum(
                math.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(texts[doc]) if tf[w]
            )
            if score:
                out[k] = score
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_neighbours_are_the_best_of_the_whole_query(seed):
    rng = np.random.default_rng(seed)
    texts = [np.minimum(rng.zipf(1.4, rng.integers(1, 60)), 80).tolist() for _ in range(40)]
    texts += [texts[0], texts[0], texts[1]]
    index = packing.Index(np.array([w for t in texts for w in t]), np.array([len(t) for t in texts]), 81)
    for doc in rng.permutation(len(texts))[:25].tolist():
        index.take(doc)
        want = plain_bm25(texts, doc, index.used)
        got = index.neighbours(doc, index.used, 8).tolist()
        assert len(got) == min(8, len(want))
        assert np.allclose([want[k] for k in got], sorted(want.values(), reverse=True)[: len(got)], rtol=1e-4)


def test_other_tokenizers_are_not_taken_apart(spark, docs, corpus, monkeypatch):
    assert packing.Ids(public_tokenizer()).apart
    import public_tokenizers

    other = public_tokenizers.path("byte_bpe_50k.json")
    ids = packing.Ids(other)
    assert not ids.apart
    rows = corpus[:20]
    pieces = packing.pack(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), other).collect()
    for r in rows:
        text = np.append(ids.whole(r[1] or ""), 1)
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == r[0])
        assert all(c == zlib.crc32(text[a : a + n].astype("<u4").tobytes()) for a, n, c in own) and sum(n for _, n, _ in own) == len(text)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    ids = packing.Ids(public_tokenizer())
    for k in range(5):
        some = [f"word{j}" for j in range(k * 20, k * 20 + 30)]
        flat, at, size = ids.table(pa.array(some, pa.large_string()))
        assert all(flat[a : a + n].tolist() == ids.whole(w).tolist() for w, a, n in zip(some, at, size, strict=True)) and len(ids.key) <= 50


# ------------------------------------------------------------------ mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=8), st.floats(0, 1))
def test_fit_is_near(counts, share):
    size = sum(n * c for n, c in counts.items())
    budget = round(share * size)
    got = mixing.fit(counts, budget)
    assert all(0 < k <= counts[n] for n, k in got.items())
    assert abs(sum(n * k for n, k in got.items()) - budget) <= max(counts)


def test_knapsack_is_exact():
    for counts, budget in (({3: 2, 5: 2}, 11), ({7: 3}, 15), ({2: 1, 9: 1}, 9), ({4: 5, 6: 5}, 21)):
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = sum(n * k for n, k in mixing.knapsack(counts, budget).items())
        assert abs(got - budget) == min(abs(s - budget) for s in sums if s <= budget + min(counts))


@pytest.mark.parametrize(
    "counts, budget, want",
    [({1000: 60, 40_000: 1}, 90_000, 90_000), ({100_000: 3}, 190_000, 200_000), ({1: 1, 100: 1}, 60, 100), ({20_000: 7, 30_001: 3, 170_000: 2}, 300_001, 300_001)],
)
@pytest.mark.parametrize("cells", [mixing.CELLS, 0])
def test_fit_with_long_documents(counts, budget, want, cells):
    got = mixing.fit(counts, budget, cells=cells)
    assert all(0 < k <= counts[n] for n, k in got.items())
    assert sum(n * k for n, k in got.items()) == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 90), st.integers(1, 4), min_size=1, max_size=6), st.floats(0, 1))
def test_fit_is_nearest_above_exact(counts, share):
    counts = {n * 1000 + n % 7: c for n, c in counts.items()}
    budget = round(share * sum(n * c for n, c in counts.items()))
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    got = sum(n * k for n, k in mixing.fit(counts, budget).items())
    assert abs(got - budget) == min(abs(s - budget) for s in sums)


def plain_targets(sizes, weights):
    goal, free, left = [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s], float(sum(sizes))
    while free:
        unit = left / sum(weights[k] for k in free)
        full = [k for k in free if weights[k] * unit >= 3 * sizes[k]]
        for k in full or free:
            goal[k] = 3.0 * sizes[k] if full else weights[k] * unit
        if not full:
            break
        left -= sum(goal[k] for k in full)
        free = [k for k in free if k not in full]
    return goal


def test_mixing(docs, corpus, nothing):
    out = mixing.mix_plan(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["mix_size"]) for r in out) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in corpus)
    sizes, source_of = defaultdict(int), {}
    for r in corpus:
        sizes[r[3]] += len(words(r[1]))
        source_of[r[0]] = r[3]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, plain_targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    taken, have = defaultdict(int), defaultdict(list)
    for r in out:
        source = source_of[r["doc_id"]]
        assert r["mix_source_size"] == sizes[source]
        assert abs(r["mix_target"] - goal[source]) < 1e-6 and 0 <= r["mix_times"] <= 3
        taken[source] += r["mix_size"] * r["mix_times"]
        have[source].append(r["mix_size"])
    for s in names:  # as near as whole documents come, above whole passes
        whole = int(goal[s] // sizes[s]) * sizes[s] if sizes[s] else 0
        sums = {0}
        for n in have[s]:
            sums |= {x + n for x in sums}
        assert abs(taken[s] - goal[s]) <= min(abs(whole + x - goal[s]) for x in sums) + 1
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert Counter(out) == Counter(again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["mix_times"] for r in out)
    assert set(map(tuple, mixed.collect())) <= set(corpus)
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# ------------------------------------------------------------------ toxicity

INSULTS = ["dolt", "oaf", "cretin"]


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(1)
    plain = [a + b for a in ("ka", "lo", "mi", "ru", "se") for b in ("n", "ra", "ts", "vel", "do")]
    rows, labels = [], []
    for k in range(700):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(INSULTS) + rng.choice(["", "!", "."])
        rows.append((k, " ".join(w), "en", "src", 0, 0.5))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None, None, None, 0, 0.1), (1001, "", None, None, 0, 0.1), (None, "dolt dolt you dolt", None, None, 0, 0.1), (1003, "you d0lt and 0af " * 3, None, None, 0, 0.1)]
    labels += [(3, 0, 0), (9999, 1, 1), (1000, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 700 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    hits = [(r["score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in held]
    assert len(held) > 100 and sum(hits) / len(hits) > 0.97
    other = {r["doc_id"]: r["score"] for r in out}
    assert other[1000] == other[1001] < 0.5 < other[None]
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_of_the_held_out_fold_change_nothing(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.drop("lang", "source"), flipped).collect()}
    assert a == b


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    one = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in one} == {0.0}


def test_isotonic_rises():
    x = np.array([0.1, 0.4, 0.35, 0.8, 0.8, 0.2])
    knots, level = toxicity.isotonic(x, np.array([0, 1, 0, 1, 0, 0.0]))
    assert (np.diff(knots) >= 0).all() and (np.diff(level) >= 0).all()


# ------------------------------------------------------------------ GIF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([2, 4, 8]))
def test_lzw_round_trip(data, least):
    data = bytes(b & (1 << least) - 1 for b in data)
    assert gif.lzw_decode(gif.lzw_encode(data, least), least, len(data)) == data


def test_lzw_of_long_and_broken_streams():
    data = os.urandom(60_000) + bytes(60_000)
    stream = gif.lzw_encode(data)
    assert gif.lzw_decode(stream, 8, len(data)) == data
    half = gif.lzw_decode(stream[: len(stream) // 2], 8, len(data))
    assert half and data.startswith(half)
    # codes after a full table without a clear code (deferred): 9-bit codes grow to 12 bits and stay
    assert gif.lzw_decode(gif.lzw_encode(data[:100]), 8, 40) == data[:40]


def test_frames_disposal_transparency_and_interlace():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    frame = lambda s, d, t=-1, x=0, w=2, h=2: gif.Frame(x, 0, w, h, bytes(s), palette, t, d, 50)
    data = gif.encode([frame([1, 1, 1, 1], 1), frame([2, 3], 3, 3, 0, 1, 2), frame([0, 2, 2, 0], 2, 0), frame([3], 0, -1, 1, 1, 1)], 2, 2, palette)
    made = gif.decode(data)
    shown = [(at, c[..., :3].tolist(), c[..., 3].tolist()) for at, c in gif.canvases(made)]
    red, green, blue, gone = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert [x[0] for x in shown] == [0, 50, 100, 150]
    assert shown[0][1] == [[red, red], [red, red]]
    assert shown[1][1] == [[green, red], [red, red]]  # 3 is transparent
    assert shown[2][1] == [[red, green], [green, red]]  # the frame before was undone, 0 is transparent
    assert shown[3][1] == [[gone, blue], [gone, gone]] and shown[3][2] == [[0, 255], [0, 0]]  # cleared
    rows = bytes(k for k in (0, 2, 1, 3) for _ in range(4))  # interlaced order of four rows
    raw = bytearray(gif.encode([gif.Frame(0, 0, 4, 4, bytes(k for k in (0, 2, 1, 3) for _ in range(4)), palette, -1, 0, 0)], 4, 4, palette))
    at = raw.index(b"\x2c", 13 + 12)
    raw[at + 9] |= 0x40
    assert gif.decode(bytes(raw)).frames[0].samples != rows
    assert [gif.decode(bytes(raw)).frames[0].samples[4 * k] for k in range(4)] == [0, 1, 2, 3]


def test_local_palette_and_malformed(spark):
    palette = np.array([[9, 9, 9], [200, 100, 50]], np.uint8)
    good = gif.encode([gif.Frame(0, 0, 3, 1, b"\1\0\1", palette, -1, 0, 20)], 3, 1, palette)
    assert gif.decode(good.replace(b"GIF89a", b"GIF87a")).frames[0].samples == b"\1\0\1"
    df = spark.createDataFrame([(1, good), (2, b"no"), (3, None), (4, good[:30])], "doc_id long, media binary")
    out = {r["doc_id"]: r for r in gif.decode_column(df).collect()}
    assert sum(out[1]["histogram"]) == 3 and out[1]["delay_ms"] == 20 and out[2]["frame"] is None and out[3]["frame"] is None
    assert out[4]["frame"] is None or out[4]["width"] == 3


def test_store(docs, corpus, nothing):
    out = gif.read_column(gif.store_column(docs)).collect()
    want = Counter()
    for r in corpus:
        raw = (r[1] or "").encode()
        p = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
        want[r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter(tuple(r[k] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in out) == want
    same = defaultdict(set)
    for r in out:
        same[r["payload_sha256"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    features = {}
    for r in corpus:
        raw = (r[1] or "").encode()
        p = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
        bins = Counter(((b >> 5) * 36 * 4 // 256) * 16 + ((b >> 2 & 7) * 36 * 4 // 256) * 4 + (b & 3) * 85 * 4 // 256 for b in p)
        features[hashlib.sha256(p).hexdigest()] = ",".join(str(bins[k] * 1000 // len(p)) for k in range(64))
    assert all(r["feature"] == features[r["payload_sha256"]] and r["frames"] == 1 and r["last_ms"] == 0 for r in out)
    assert all(len(v) == 1 for v in same.values())
    assert gif.read_column(gif.store_column(nothing)).count() == 0


def test_long_payload_has_frames():
    data = gif.pad(os.urandom(gif.WIDTH * gif.ROWS + 5))
    payload, counts, starts = gif.read(gif.store(data))
    assert payload == data and starts == [0, 100] and counts.sum() == len(data)


def test_reading_malformed_media(spark):
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    other = gif.encode([gif.Frame(0, 0, 2, 1, b"\1\2", grey, -1, 0, 0)], 2, 1, grey)
    df = spark.createDataFrame([(1, 1, None, 5), (2, 1, b"GIF89a", 5), (3, 1, other, 5), (4, 1, gif.store(gif.pad(b"x")), 5)], "doc_id long, n_bytes long, media binary, feature int")
    out = {r["doc_id"]: r for r in gif.read_column(df).collect()}
    assert out[1]["media_bytes"] is None and out[2]["media_bytes"] == 6
    assert all(out[k]["payload_bytes"] is None and out[k]["feature"] is None for k in (1, 2, 3)) and out[4]["payload_bytes"] == 576


def test_lzw_segment_is_decoded_without_a_loop_over_codes():
    codes = np.array([97, 258, 259, 98, 258])  # an entry that is used in the turn that makes it, twice
    samples, first, length = gif._stood_for(codes, 256, 100)
    assert samples.tobytes() == b"aaaaaabaa" and first.tolist() == [0, 1, 3, 6, 7] and length.tolist() == [1, 2, 3, 1, 2]
    assert gif._stood_for(codes, 256, 2)[0].tobytes() == b"aaa"
    for bad in ([258], [97, 259], [97, 258, 260]):
        with pytest.raises(ValueError):
            gif._stood_for(np.array(bad), 256, 100)


@pytest.mark.parametrize("most", [1, 9000, 59_999, 60_000])
def test_lzw_table_that_stays_full(most):
    rng = random.Random(5)
    data = bytes(rng.choices(range(16), k=60_000))
    table, codes, last = {}, [16], data[0]
    for b in data[1:]:
        if (last, b) in table:
            last = table[last, b]
            continue
        codes.append(last)
        if len(table) < 4096 - 18:
            table[last, b] = 18 + len(table)
        last = b
    codes = np.array([*codes, last, 17])
    widths = gif._widths(4)[np.minimum(np.arange(len(codes)), 4095)]
    widths[0] = 5
    assert gif.lzw_decode(gif._bits(codes, widths), 4, most) == data[:most]
