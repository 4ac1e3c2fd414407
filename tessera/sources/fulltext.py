"""Full texts: TEI from a PDF service, else HTML, else the abstract.

Pages and PDFs come as tables of fetched bodies, so the choice is a ``coalesce``;
fetching them is :mod:`tessera.sources.http`'s part, outside the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Config
from tessera.sources.http import HttpClient
from tessera.sources.html import html_sections, sections, tei_sections


def html_urls(paper_id: str) -> list[str]:
    return [f"https://arxiv.org/html/{paper_id}", f"https://ar5iv.labs.arxiv.org/html/{paper_id}", f"https://ar5iv.org/abs/{paper_id}"]


def html_request(http: HttpClient, row: dict) -> str | None:
    """The first of the pages that answers and has sections."""
    for url in html_urls(row["arxiv_id"]):
        try:
            body = http.get_text(url)
        except OSError:
            continue
        if html_sections(body):
            return body
    return None


def tei_request(service: str):
    """A request that has a PDF service read the paper's PDF."""

    def request(http: HttpClient, row: dict) -> str | None:
        pdf = http.get_bytes(row.get("pdf_url") or f"https://arxiv.org/pdf/{row['arxiv_id']}")
        body = http.post_file(f"{service.rstrip('/')}/api/processFulltextDocument", "input", pdf)
        return body.decode("utf-8", "replace") if tei_sections(body.decode("utf-8", "replace")) else None

    return request


def full_texts(papers: DataFrame, config: Config, tei: DataFrame | None = None, html: DataFrame | None = None) -> DataFrame:
    """``arxiv_id, sections, source``.  ``tei`` and ``html`` hold ``arxiv_id, body``.

    With the PDF service on, a paper without TEI goes on to HTML, and without that
    to its abstract; an empty list of sections counts as a miss."""
    out = papers.select("arxiv_id", F.array(F.struct(F.lit("Abstract").alias("title"), F.coalesce("abstract", F.lit("")).alias("text"), F.lit(None).cast("int").alias("page"))).cast(f"array<{schemas.SECTION}>").alias("_abstract"))
    choices = []
    for name, table, parse, wanted in (("grobid", tei, tei_sections, config.extraction.use_grobid), ("html", html, html_sections, config.extraction.prefer_html)):
        if wanted and table is not None:
            found = sections(table.select("arxiv_id", "body").dropDuplicates(["arxiv_id"]), "body", f"_{name}", parse).select("arxiv_id", f"_{name}").where(F.size(f"_{name}") > 0)
            out = out.join(found, "arxiv_id", "left")
            choices.append((name, F.col(f"_{name}")))
    source = F.lit("abstract")
    for name, c in reversed(choices):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return out.select("arxiv_id", F.coalesce(*[c for _, c in choices], F.col("_abstract")).alias("sections"), source.alias("source"))
