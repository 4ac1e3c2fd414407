"""Text columns: normalisation, terms, tokens, ids and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(text: Column | str) -> Column:
    """Lower case; each run of anything but ``[a-z0-9 ]`` becomes one space; spaces stay as they are."""
    return F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9 ]+", " ")


def contains_term(normalized: Column, term: str) -> Column:
    """A term with a space or hyphen is a plain substring; any other stands between token borders."""
    term = term.lower().strip()
    if not term:
        return F.lit(False)
    if " " in term or "-" in term:
        plain = F.trim(normalize(F.lit(term)))
        return F.contains(normalized, plain)
    quoted = term.replace("\\E", "\\E\\\\E\\Q")
    return normalized.rlike(rf"(?<![a-z0-9])\Q{quoted}\E(?![a-z0-9])")


def matched_terms(normalized: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms that the text contains, in the order given."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(contains_term(normalized, t), F.lit(t)) for t in terms]))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def collapse(text: Column | str) -> Column:
    """Any run of white space, Unicode's too, becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)[\s\x1c-\x1f]+", " "))


def strip(text: Column | str) -> Column:
    """Without white space, line ends too, at either end; null counts as empty."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """Words between white space; an empty array for a text without any."""
    flat = collapse(F.coalesce(_c(text), F.lit("")))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def hash_tokens(text: Column | str) -> Column:
    """Words, word bigrams and padded character trigrams of words of three letters or more."""
    return hash_terms(tokens(text))


def hash_terms(w: Column | str) -> Column:
    """The same of an array of words as :func:`tokens` makes them.

    Words hold no space, so bigrams and trigrams are written by one replacement each over all words in one string."""
    w = _c(w)
    flat = F.array_join(w, " ")
    pairs = F.regexp_replace(flat, r"(\S++) (?=(\S++))(?:\S++\z)?", "$1_$2 ")  # the last word goes with the last pair
    bigrams = F.slice(F.split(pairs, " "), F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    long = F.rtrim(F.regexp_replace(flat, r"(?<!\S)\S{1,2}(?: |\z)", ""))
    padded = F.concat(F.lit("#"), F.replace(long, F.lit(" "), F.lit("# #")), F.lit("#"))
    grams = F.rtrim(F.regexp_replace(padded, r"(?=(\S{3}))\S(?:\S\S(?: |\z))?", "c:$1 "))  # a word's last two go with its last trigram
    return F.concat(w, bigrams, F.array_remove(F.split(grams, " "), "##"))  # that is left where no word is long


def strip_version(id_: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(id_)), "^(.+)v[0-9]+$", "$1")


def versioned(id_: Column | str, version: Column | str) -> Column:
    return F.concat(_c(id_), F.lit("v"), _c(version).cast("string"))


def id_and_version(url: Column | str) -> tuple[Column, Column]:
    """Id and version (1 where none is given) of a paper's URL."""
    last = F.regexp_extract(F.trim(_c(url)), r"(?:.*/abs/|^)(.+)$", 1)
    number = F.regexp_extract(last, r"v([0-9]+)$", 1)
    return F.regexp_replace(last, "^(.+)v[0-9]+$", "$1"), F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999999")), F.lit(1)).cast("int")


def utc_timestamp(text: Column | str) -> Column:
    """An ISO timestamp; one without a zone is in UTC, whatever the session's zone; null if it is none."""
    t = F.trim(_c(text))
    day, zoned = t.rlike(r"^[+-]?[0-9]+(-[0-9]{1,2}){0,2}$"), t.rlike(r"(?i)([a-z)]|[+-][0-9]{1,2}(:?[0-9]{2}){0,2})$") & t.rlike("[T ]")
    return F.try_to_timestamp(F.when(day, F.concat(t, F.lit("T00:00:00Z"))).when(zoned, t).otherwise(F.concat(t, F.lit("Z"))))


def title_and_abstract(title: Column | str, abstract: Column | str) -> Column:
    blank = F.lit("")
    return F.trim(F.concat(F.coalesce(_c(title), blank), F.lit(" [SEP] "), F.coalesce(_c(abstract), blank)))


def full_text(sections: Column | str) -> Column:
    return F.array_join(F.transform(_c(sections), lambda s: F.concat(F.when(F.coalesce(s["title"], F.lit("")) != "", F.concat(F.lit("## "), s["title"], F.lit("\n"))).otherwise(F.lit("")), F.coalesce(s["text"], F.lit("")))), "\n\n")


def title_words(title: Column | str) -> Column:
    return F.array_join(tokens(title), " ")


def block_key(title: Column | str) -> Column:
    """First alphanumeric word, or nothing."""
    return F.regexp_extract(F.lower(F.coalesce(_c(title), F.lit(""))), "[a-z0-9]+", 0)


def author_key(name: Column | str) -> Column:
    return collapse(F.lower(_c(name)))


def shorten(text: Column | str, most: int = 90) -> Column:
    t = collapse(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def cell(text: Column | str) -> Column:
    """One cell of a Markdown table."""
    return F.trim(F.replace(F.replace(_c(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def paper_link(id_: Column | str) -> Column:
    return F.concat(F.lit("["), _c(id_), F.lit("](https://arxiv.org/abs/"), _c(id_), F.lit(")"))


def request_key(schema: str, cache_key: Column, prompt: Column) -> Column:
    return F.concat(F.lit(f"{schema}:"), F.coalesce(cache_key, F.substring(F.sha2(prompt, 256), 1, 16)))


def reference_id(external: Column) -> Column:
    """An ArXiv id, else a corpus id, of a struct of external ids."""
    return F.coalesce(F.nullif(external["ArXiv"], F.lit("")), F.concat(F.lit("CorpusId:"), external["CorpusId"]))


def seed_id(id_: Column | str) -> Column:
    c = _c(id_)
    return F.when(F.contains(c, F.lit(":")), c).otherwise(F.concat(F.lit("ARXIV:"), c))


def category_query(categories: list[str] | tuple[str, ...]) -> str:
    return " OR ".join(f"cat:{c}" for c in (categories or ["cs.LG"]))


def array_union_distinct(a: Column | str, b: Column | str) -> Column:
    """``a`` followed by what only ``b`` holds, without blanks."""
    empty = F.array().cast("array<string>")
    return F.filter(F.array_union(F.coalesce(_c(a), empty), F.coalesce(_c(b), empty)), lambda x: x.isNotNull() & (x != ""))
