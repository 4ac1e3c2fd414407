"""Lexical retrieval packing: related documents share a sequence.

Documents are dealt into shards of about ``SHARD_BYTES`` of text.  A shard is one
task: it tokenizes its documents, builds a BM25 inverted index over their words,
and packs.  A seed document opens a sequence; the index scores all its words
against every unused document of the shard and returns the best, which fill the
window greedily: a neighbour that fits goes in whole;
when none fits, the best one is cut and its rest opens the next sequence, and
without a neighbour the next unused document comes.  So every sequence but the
last of a shard is full, and the last is cut into powers of two, which need no
padding, as long as that leaves pieces of ``LEAST`` tokens or more.

Tokens: a public tokenizer's ids without special tokens, then one end id.  Words
are tokenized apart and remembered where the tokenizer drops the case of ASCII and
never joins across white space or before ``ENDS``, which ``Ids`` probes when it
loads a file; with any other file, and in texts with one of its special strings,
texts are encoded whole.

Defined cases: null text counts as empty and is one end id; rows equal in id and
text are each packed; a null id is packed as any other; other columns are not
read; an empty table gives no piece.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import U64, column, hash_words, partitions, slices, small_batches, split_words, starts_of, text_bytes

WINDOW, END = 2048, 1
TOKENIZER = "word_bpe_49k.json"
SHARD_BYTES = 8 << 20
#: Unused neighbours looked at before the index is asked again.
NEIGHBOURS = 16
#: A word in one of so many documents of a shard, or in more, has a weight for every document instead of postings.
FREQUENT = 8
#: Words whose ids a worker remembers.
REMEMBERED = 1_500_000
#: Marks that, behind a letter or digit, are a piece of their own for a tokenizer that ``Ids`` takes apart.
ENDS = (".", ",")
K1, B = 1.2, 0.75
LEAST = 32


class Ids:
    """Token ids of words, by a file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: k for k, t in special.items()}
        # a special token that strips nothing beside it may stand between words
        self.between = next((t.content for t in special.values() if not (t.lstrip or t.rstrip or t.single_word)), None)

        self._forget()
        self.apart = self._apart()

    def _apart(self) -> bool:
        """Whether words, and ends behind letters, may be tokenized apart and in lower case: probed on words of several kinds."""
        of = lambda t: self.whole(t).tolist()
        probes = ["a", "Word", "THE", "x1", "42", "Straße", "école", "Ñandú", "naïve-ly", "don't", "日本", "tokenization", "Zzyzx"]
        joins = all(of(f"{a}{gap}{b}") == of(a) + of(b) for a, b in zip(probes, probes[1:], strict=False) for gap in (" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"))
        ends = all(of(w + e) == of(w) + of(e) for w in probes for e in ENDS)
        return joins and ends and all(of(w) == of(w.lower()) for w in probes if w.isascii())

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids among which those of each of the distinct ``words`` stand, where they begin, and their number."""
        one, two = hash_words(words)
        seen = self._seen(one, two)
        if len(self.key) + int((~seen).sum()) > REMEMBERED:
            self._forget()
            seen[:] = False
        if not seen.all():
            self._remember(one[~seen], two[~seen], *self._learnt(words.filter(pa.array(~seen)).to_numpy(zero_copy_only=False).tolist()))
        at = np.searchsorted(self.key, one)
        return self.ids, self.at[at], self.size[at]

    def _forget(self) -> None:
        """Known words: hashes, the first ascending, and where their ids begin in ``ids``, and their number."""
        self.key, self.check, self.at, self.size = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _seen(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(self.key, one), len(self.key) - 1)
        return (self.key[at] == one) & (self.check[at] == two)

    def _remember(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.ids) + starts_of(size)[:-1]
        order = np.argsort(one)
        place = np.searchsorted(self.key, one[order])
        more = zip((self.key, self.check, self.at, self.size), (one, two, at, size), strict=True)
        self.key, self.check, self.at, self.size = (np.insert(old, place, new[order]) for old, new in more)
        self.ids = np.concatenate([self.ids, ids])

    def _learnt(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and their number for each."""
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 1024):
            some = words[k : k + 1024]
            joined = self.between.join(some) if self.between else ""
            if self.between and all(joined.count(s) == (len(some) - 1) * (s == self.between) for s in self.special):
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
                cut = np.flatnonzero(ids == self.special[self.between])
                if len(cut) == len(some) - 1:
                    sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                    parts.append(np.delete(ids, cut))
                    continue
            each = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in each]))
            parts += each
        return np.concatenate(parts), np.concatenate(sizes)

    def spell(self, codes: np.ndarray, n: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as word numbers, an end id behind each, and their number for each text."""
        flat, where, size = self.table(words)
        flat, where, size = np.append(flat, np.int32(END)), np.append(where, len(flat)), np.append(size, 1)
        ends = starts_of(n)[1:] + np.arange(len(n))
        order = np.full(len(codes) + len(n), len(words), np.int64)
        order[np.delete(np.arange(len(order)), ends)] = codes
        length = size[order]
        total = np.add.reduceat(length, np.concatenate([[0], ends[:-1] + 1])) if len(n) else np.zeros(0, np.int64)
        out = np.empty(int(length.sum()), np.int32)
        done = 0
        for k in range(0, len(order), 1 << 20):
            some, m = where[order[k : k + (1 << 20)]], length[k : k + (1 << 20)]
            at = np.arange(int(m.sum())) - np.repeat(starts_of(m)[:-1] - some, m)
            out[done : done + len(at)] = flat[at]
            done += len(at)
        return out, total


def split_ends(words: pa.Array, special: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Fewer words to tokenize: for each word the number of its stem, its end (0: none, else of ``ENDS``), and the stems.

    ASCII words lose their case, as the tokenizer drops it, unless that makes a special string;
    an end is cut only behind a letter or digit of ASCII or Latin-1, where the tokenizer cuts too."""
    low, plain = pc.ascii_lower(words), pc.string_is_ascii(words)
    for s in special:
        plain = pc.and_(plain, pc.invert(pc.match_substring(low, s)))
    low = pc.if_else(plain, low, words)
    cut = pc.match_substring_regex(low, "[A-Za-z0-9À-ÖØ-öø-ÿ][.,]$")
    coded = pc.if_else(cut, pc.utf8_slice_codeunits(low, 0, -1), low).dictionary_encode()
    dot = pc.and_(cut, pc.ends_with(low, ENDS[0])).to_numpy(zero_copy_only=False)
    end = np.where(cut.to_numpy(zero_copy_only=False), np.where(dot, 1, 2), 0)
    return coded.indices.to_numpy().astype(np.int64), end, coded.dictionary


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def texts_to_ids(encode: Ids, parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of all texts: ids, their number for each text, lower-cased word numbers, their number for each text, distinct words."""
    flat, n, odd, before = [pa.array([], pa.large_string())], [], [], 0
    for texts in parts:
        own, k = split_words(texts)
        flat.append(own)
        n.append(k)
        for s in encode.special:
            hit = np.flatnonzero(pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False))
            odd += [(before + int(h), texts[int(h)].as_py()) for h in hit]
        before += len(texts)
    n, coded = np.concatenate([np.zeros(0, np.int64), *n]), pa.concat_arrays(flat).dictionary_encode()
    del flat
    codes = coded.indices.to_numpy()
    low = pc.ascii_lower(coded.dictionary).dictionary_encode()
    words = low.indices.to_numpy()[codes] if len(codes) else codes
    if not encode.apart:
        own = [np.append(encode.whole(t or ""), np.int32(END)) for texts in parts for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.int32), *own]), np.array([len(x) for x in own], np.int64), words, n, len(low.dictionary)
    stem, end, stems = split_ends(coded.dictionary, list(encode.special))
    # an end that is a stem too keeps its number
    stems = pa.concat_arrays([stems, pa.array(ENDS, stems.type)]).dictionary_encode()
    number, stems = stems.indices.to_numpy().astype(np.int64), stems.dictionary
    each = 1 + (end[codes] > 0)
    units = np.repeat(number[stem[codes]], each)
    last = np.cumsum(each)[each > 1] - 1
    units[last] = number[-len(ENDS) :][end[codes][each > 1] - 1]
    ids, total = encode.spell(units, np.diff(np.concatenate([[0], np.cumsum(each)])[starts_of(n)]), stems)
    del units, last, each
    if odd:  # a special string may stand inside a word or across words
        own = np.split(ids, starts_of(total)[1:-1])
        for k, text in odd:
            own[k] = np.append(encode.whole(text), np.int32(END))
        ids, total = np.concatenate(own), np.array([len(x) for x in own])
    return ids, total, words, n, len(low.dictionary)


class Index:
    """BM25 over the words of some documents; documents taken out leave it.

    A frequent word has a row of weights, one for each document; the others have postings, sorted by word."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, n_words: int):
        docs = np.repeat(np.arange(len(n)), n)
        pairs, tf = np.unique(docs * np.int64(max(n_words, 1)) + codes, return_counts=True)
        doc, self.word = pairs // max(n_words, 1), pairs % max(n_words, 1)
        df = np.bincount(self.word, minlength=n_words)
        idf = np.log1p((len(n) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * n / max(n.mean(), 1)) if len(n) else n
        weight = (idf[self.word] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.first = np.searchsorted(doc, np.arange(len(n) + 1))
        #: Row of a frequent word, -1 of others.
        self.row = np.full(n_words, -1)
        frequent = np.flatnonzero(df * FREQUENT >= len(n)) if len(n) > FREQUENT else np.zeros(0, np.int64)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), len(n)), np.float32)
        often = self.row[self.word] >= 0
        self.rows[self.row[self.word[often]], doc[often]] = weight[often]
        word, doc, weight = self.word[~often], doc[~often], weight[~often]
        by_word = np.argsort(word, kind="stable")
        self.live = np.bincount(word, minlength=n_words)
        self.at, self.posting, self.weight = starts_of(self.live), doc[by_word].astype(np.int32), weight[by_word]
        self.used = np.zeros(len(n), bool)
        self.gone = 0

    def take(self, doc: int) -> None:
        """Takes ``doc`` out; postings are rewritten each time half of them are gone."""
        words = self.word[self.first[doc] : self.first[doc + 1]]
        words = words[self.row[words] < 0]
        self.used[doc] = True
        self.live[words] -= 1
        self.gone += len(words)
        if 2 * self.gone > len(self.posting):
            keep = ~self.used[self.posting]
            self.at, self.posting, self.weight, self.gone = starts_of(self.live), self.posting[keep], self.weight[keep], 0

    def scores(self, doc: int) -> np.ndarray:
        """The BM25 score of every document that is not taken out for all words of ``doc``."""
        words = self.word[self.first[doc] : self.first[doc + 1]]
        row = self.row[words]
        asked = np.zeros(len(self.rows), np.float32)
        asked[row[row >= 0]] = 1
        words = words[(row < 0) & (self.live[words] > (not self.used[doc]))]
        start, size = self.at[words], self.at[words + 1] - self.at[words]
        place = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        out = np.bincount(self.posting[place], self.weight[place], len(self.used))
        return out + asked @ self.rows

    def neighbours(self, doc: int, used: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
        """The best unused documents that share a word with ``doc``, best first, ties by number."""
        score = self.scores(doc)
        score[used] = 0
        score[doc] = 0
        if most < len(score):
            least = np.partition(score, len(score) - most)[len(score) - most]
            docs = np.flatnonzero((score >= least) & (score > 0))
        else:
            docs = np.flatnonzero(score)
        return docs[np.lexsort((docs, -score[docs]))][:most]


def pack_shard(length: np.ndarray, index: Index, window: int = WINDOW, twins: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of so many ids.

    Documents of one number in ``twins`` are copies and one entry of ``index``, that of this number:
    they are not sought as each other's neighbours, and a neighbour is its first unused copy."""
    twins = np.arange(len(length)) if twins is None else twins
    copies, n_copies = np.argsort(twins, kind="stable"), np.bincount(twins, minlength=1)
    first, taken = starts_of(n_copies), np.zeros(len(n_copies), np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(len(length), bool)
    sequence, filled, following = 0, 0, 0
    n = len(length)

    def put(doc: int) -> None:
        """Ids of ``doc``, over as many sequences as it takes."""
        nonlocal sequence, filled
        used[doc] = True
        taken[twins[doc]] += 1
        if taken[twins[doc]] == n_copies[twins[doc]]:
            index.take(int(twins[doc]))
        done, left = 0, int(length[doc])
        while left:
            k = min(left, window - filled)
            pieces.append((doc, done, k, sequence, filled))
            done += k
            left -= k
            filled += k
            if filled == window:
                sequence, filled = sequence + 1, 0

    while True:
        while following < n and used[following]:
            following += 1
        if following == n:
            break
        seed = following
        put(seed)
        while filled:
            near = index.neighbours(int(twins[seed]), index.used)
            if not len(near):
                break
            near = copies[first[near] + taken[near]]
            room = window - filled
            fits = near[length[near] <= room]
            if not len(fits):
                put(int(near[0]))  # cut: its rest opens the next sequence and is the seed there
                seed = int(near[0])
                continue
            for doc in fits:
                if length[doc] <= window - filled:
                    put(int(doc))
    return _powers(pieces, sequence, filled) if filled else pieces


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as numbers in order of first appearance, and where each number appears first."""
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    by_place = np.argsort(first)
    number = np.empty(len(first), np.int64)
    number[by_place] = np.arange(len(first))
    return number[which], first[by_place]


def _powers(pieces: list, sequence: int, filled: int, least: int = LEAST) -> list:
    """The last, unfilled sequence as sequences of powers of two, largest first."""
    last = [p for p in pieces if p[3] == sequence]
    out = pieces[: len(pieces) - len(last)]
    sizes = [1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1]
    kept = [s for s in sizes if s >= least]
    if sum(kept) < filled:
        kept.append(filled - sum(kept))  # padded: it is short
    nr, offset, room = sequence, 0, kept[0]
    rest = iter(kept[1:])
    for doc, start, length, *_ in last:
        while length:
            k = min(length, room)
            out.append((doc, start, k, nr, offset))
            start, length, offset, room = start + k, length - k, offset + k, room - k
            if not room:
                nr, offset, room = nr + 1, 0, next(rest, 0)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece, and ``ids`` if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark, text_bytes(docs), SHARD_BYTES)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def packed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        doc_ids: list[int | None] = []
        parts: list[pa.Array] = []
        for batch in batches:
            for part in slices(batch):
                doc_ids += column(part, "doc_id").to_pylist()
                parts.append(column(part, "text"))
        ids, length, words, n_words, distinct = texts_to_ids(ids_of(tokenizer), parts)
        del parts
        # order that does not hang on how rows arrived: longest first, then by content
        at = starts_of(length)
        crc, twins, seen = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), {}
        for k in range(len(length)):
            own = ids[at[k] : at[k + 1]].astype("<u4").tobytes()
            crc[k], twins[k] = zlib.crc32(own), seen.setdefault(hashlib.blake2b(own, digest_size=16).digest(), len(seen))
        order = np.lexsort((np.array([-1 if x is None else x for x in doc_ids]), crc, -length))
        # copies are one entry of the index, numbered in that order
        twins, entries = numbered(twins[order])
        entries, where = order[entries], starts_of(n_words)
        index = Index(np.concatenate([words[where[k] : where[k + 1]] for k in entries]).astype(np.int64), n_words[entries], distinct)
        del words
        pieces = pack_shard(length[order], index, window, twins)
        for k in range(0, len(pieces), 20_000):
            some = pieces[k : k + 20_000]
            spans = [(at[order[d]] + s, at[order[d]] + s + m) for d, s, m, _, _ in some]
            cols = [
                pa.array([doc_ids[order[p[0]]] for p in some], pa.int64()),
                pa.array([p[1] for p in some], pa.int64()),
                pa.array([p[2] for p in some], pa.int64()),
                pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in spans], pa.int64()),
                pa.array([length[order[p[0]]] for p in some], pa.int64()),
                pa.array([(shard << 32) + p[3] for p in some], pa.int64()),
                pa.array([p[4] for p in some], pa.int64()),
            ]
            if with_ids:
                cols.append(pa.array([ids[a:b] for a, b in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select("doc_id", text).withColumn("shard", shard).groupBy("shard").applyInArrow(packed, schema)
