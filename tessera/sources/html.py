"""HTML and TEI documents to arrays of sections; a parser, so an Arrow function around the standard library."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from tessera import schemas

# Elements that carry no text, that open a section, and that end a word.
SILENT = frozenset("script style noscript head".split())
HEADINGS = frozenset("h1 h2 h3".split())
BREAKS = frozenset(
    "p div section article li ul ol tr td th table br blockquote figure figcaption header footer aside main nav pre h4 h5 h6 dd dt dl".split()
)


#: Marks in a list of pieces: where a heading begins, and where one ends.
BEGIN, END = object(), object()


def _tidy(pieces: list) -> str:
    return " ".join("".join(x for x in pieces if isinstance(x, str)).split())


class _Events(HTMLParser):
    """What a document says, as events ``(kind, text or tag)``; kinds are ``say``, ``open``, ``close``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.all: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.all.append(("open", tag))
        self.handle_endtag = lambda tag: self.all.append(("close", tag))
        self.handle_data = lambda data: self.all.append(("say", data))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.all += [] if tag in SILENT else [("open", tag), ("close", tag)]


def _audible(events: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The events outside silent elements; a closing tag without its opening one silences nothing."""
    depth = 0
    for kind, what in events:
        if kind != "say" and what in SILENT:
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif not depth:
            yield kind, what


def _cut(pieces: list, mark: object) -> list[list]:
    """The pieces before, between and behind all places of a mark."""
    at = [-1, *(k for k, x in enumerate(pieces) if x is mark), len(pieces)]
    return [pieces[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]


def html_sections(html: str | None) -> list[tuple[str, str]]:
    """``(title, text)`` by h1 to h3; text before the first heading is a section without title.

    The text becomes one list of pieces in which headings are marked; cut before each
    heading, every part but the first is a title, an end mark and a body.  A heading that
    another one or the end of the document interrupts is lost."""
    reader = _Events()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass  # what was read up to here stands
    heading = {"open": BEGIN, "close": END}
    pieces = [what if kind == "say" else heading[kind] if what in HEADINGS else " " for kind, what in _audible(reader.all) if kind == "say" or what in HEADINGS or what in BREAKS]
    first, *rest = _cut(pieces, BEGIN)
    found = [("", _tidy(first))]
    for part in rest:
        title, *bodies = _cut(part, END)
        if bodies:
            found.append((_tidy(title), _tidy(sum(bodies, []))))
    return [s for s in found if any(s)]


def tei_sections(xml: str | None) -> list[tuple[str, str]]:
    """``(title, text)`` of the ``div`` elements of a TEI body, whatever the namespace; malformed XML has none."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    text = lambda e: " ".join("".join(e.itertext()).split())
    out = []
    for abstract in (e for e in root.iter() if local(e) == "abstract"):
        if body := text(abstract):
            out.append(("Abstract", body))
    for body in (e for e in root.iter() if local(e) == "body"):
        for div in (e for e in body.iter() if local(e) == "div"):
            title = next((text(e) for e in div if local(e) == "head"), "")
            parts = [text(e) for e in div if local(e) == "p"]
            whole = " ".join(p for p in parts if p)
            if title or whole:
                out.append((title, whole))
    return out


def _few(batches: Iterator[pa.RecordBatch], most: int = 64) -> Iterator[pa.RecordBatch]:
    """Parts of so many rows: what is parsed takes many times its text."""
    return (b.slice(k, most) for b in batches for k in range(0, b.num_rows, most))


def sections(df: DataFrame, column: str, name: str = "sections", parse=html_sections) -> DataFrame:
    """``df`` with an array of sections made from a text column."""
    kind = schemas.datatype(f"array<{schemas.SECTION}>")
    arrow = pa.list_(pa.struct([("title", pa.string()), ("text", pa.string()), ("page", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            rows = [[{"title": t, "text": x, "page": None} for t, x in parse(v)] for v in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, arrow)], [*b.schema.names, name])

    return df.mapInArrow(read, StructType([*df.schema.fields, StructField(name, kind)]))
