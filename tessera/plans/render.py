"""Backlog and digest as Markdown and HTML.

Rows become text in the plan; the driver joins the lines of a bounded view (at most
``top_n`` items, or those of one digest window)."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import text as X
from tessera.operators import filters, rank


def backlog_rows(items: DataFrame) -> DataFrame:
    """``place, line``: a table row for each item, by score."""
    ranked = rank.global_rank(items, [F.desc("score"), F.asc("id")], "_place")
    deps = F.when(F.size("dependencies") > 0, X.cell(F.array_join("dependencies", ", "))).otherwise(F.lit("—"))
    r = F.col("rice")
    cells = [
        (F.col("_place") + 1).cast("string"), F.format_string("%.3f", "score"), X.cell("title"), F.format_string("%.2f", r["expected_impact"]), F.format_string("%.2f", r["applicability"]),
        F.format_string("%.2f", r["confidence"]), F.format_string("%.1f", r["effort"]), F.when(F.col("foundational"), "✓").otherwise("—"), X.paper_link("paper_id"), deps,
    ]
    return ranked.select((F.col("_place") + 1).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


COLUMNS = ("Rank", "Score", "Title", "Impact", "Applic", "Conf", "Effort", "Foundational", "Paper", "Dependencies")
ALIGN = ("---:", "---:", "---", "---:", "---:", "---:", "---:", ":--:", "---", "---")


def backlog_lines(items: DataFrame, config: Config) -> DataFrame:
    """``place, line`` of the ranked table and the foundational lane, in the order of place."""
    spark, slots = items.sparkSession, config.scoring.foundational_reserved_slots
    shown, founded = items.agg(F.count("*"), F.count_if("foundational")).first()
    # fixed values: headings, notes and column names
    head = [
        f"# Research backlog — {config.name}", "", f"_{shown} item(s) shown · top_n = {config.delivery.top_n} · {slots} foundational slots reserved._", "",
        "| " + " | ".join(COLUMNS) + " |", "| " + " | ".join(ALIGN) + " |",
    ]
    tail = ["", "## Foundational lane", "", f"Reserved anti-recency-bias slots: {min(founded, slots)} of {slots} filled.", ""]
    tail += [] if founded else ["- _No foundational items in the current backlog._"]
    lane = rank.global_rank(items.where("foundational"), [F.desc("score"), F.asc("id")], "_place")
    lane = lane.select((shown + len(tail) + 1 + F.col("_place")).alias("place"), F.format_string("- **%s** (score %.3f) — %s", X.cell("title"), F.col("score"), X.paper_link("paper_id")).alias("line"))
    fixed = [*((k - len(head), x) for k, x in enumerate(head)), *((shown + 1 + k, x) for k, x in enumerate(tail))]
    return spark.createDataFrame(fixed, "place long, line string").unionByName(backlog_rows(items)).unionByName(lane)


def backlog_markdown(items: DataFrame, config: Config) -> str:
    """The same as one text, for a bounded set of items."""
    return "".join(f"{x['line']}\n" for x in backlog_lines(items, config).orderBy("place").collect())


def digest(items: DataFrame, now: Column, config: Config, window_days: int | None = None) -> dict:
    """``title, date, window, new_items, top_items, markdown, html``; a window of 0 means the configured one."""
    window = window_days or config.delivery.digest_window_days
    names = ["title", "paper_id", "score", "foundational", "contributions", "applicability", "reviewer_notes", "rice"]
    new = [x.asDict(True) for x in filters.digest_view(filters.new_in_window(items, now, window)).orderBy(F.desc("score"), "id").select(*names).collect()]
    top = [x.asDict(True) for x in filters.digest_view(rank.select_top(items, config)).orderBy(F.desc("score"), "id").select(*names).collect()]
    date = items.sparkSession.range(1).select(F.date_format(now, "yyyy-MM-dd")).first()[0]
    out = {"title": f"{config.name} digest" if config.name else "digest", "date": date, "window": window, "new_items": new, "top_items": top}
    out["markdown"] = _markdown(out)
    out["html"] = _html(out) if config.delivery.render_html else None
    return out


def _link(paper: str) -> str:
    return f"[{paper}](https://arxiv.org/abs/{paper})"


def _markdown(d: dict) -> str:
    lines = [f"# {d['title']} — {d['date']}", "", f"**{len(d['new_items'])}** new backlog item(s) in the last {d['window']} day(s).", "", "## New this window", ""]
    for x in d["new_items"]:
        r = x["rice"]
        lines += [
            f"- **{x['title']}** · score {x['score']:.3f}{' · _foundational_' if x['foundational'] else ''}",
            f"  - _Contributions:_ {x['contributions'] or '—'}",
            f"  - _Applicable to our work:_ {x['applicability'] or '—'}",
            f"  - _Additional context:_ {x['reviewer_notes'] or '—'}",
            f"  - _Impact_ {r['expected_impact']:.2f} · _Applicability_ {r['applicability']:.2f} · _Confidence_ {r['confidence']:.2f} · _Effort_ {r['effort']:.1f}/10",
            f"  {_link(x['paper_id'])}",
        ]
    lines += [] if d["new_items"] else ["_No new items in this window._"]
    first = d["top_items"][:10]
    lines += ["", f"## Current top {len(first)} backlog", ""]
    lines += [f"{k}. **{x['title']}** · score {x['score']:.3f}{' · foundational' if x['foundational'] else ''} · {_link(x['paper_id'])}" for k, x in enumerate(first, 1)]
    return "\n".join([*lines, ""])


def _html(d: dict) -> str:
    e = lambda x: html.escape(str(x or "—"))
    link = lambda p: f'<a href="https://arxiv.org/abs/{html.escape(p, quote=True)}">{html.escape(p)}</a>'
    cards = [
        f"<li><h3>{e(x['title'])}</h3><p>score {x['score']:.3f}</p><dl><dt>Contributions</dt><dd>{e(x['contributions'])}</dd><dt>Applicable to our work</dt><dd>{e(x['applicability'])}</dd>"
        f"<dt>Additional context</dt><dd>{e(x['reviewer_notes'])}</dd></dl>{link(x['paper_id'])}</li>"
        for x in d["new_items"]
    ]
    top = [f"<li>{e(x['title'])} · {x['score']:.3f} · {link(x['paper_id'])}</li>" for x in d["top_items"][:10]]
    return (
        f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{e(d["title"])} — {e(d["date"])}</title></head><body><h1>{e(d["title"])} — {e(d["date"])}</h1>'
        f"<h2>New this window</h2><ul>{''.join(cards) or '<li>No new items in this window.</li>'}</ul><h2>Current top {len(top)} backlog</h2><ol>{''.join(top)}</ol></body></html>\n"
    )
