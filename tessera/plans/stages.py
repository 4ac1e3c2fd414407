"""The five stages over a store: source, filter, extract, score, deliver.

Each stage reads snapshots, computes one DataFrame and writes it once, so a stage
that runs again changes nothing it has already done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Config
from tessera.functions import text as X
from tessera.functions.embedders import embedder
from tessera.operators import aggregates, chunking, dedup, filters, graph, joins, models, rank, recorded, relevance, score
from tessera.plans import render
from tessera.sources import delivery, fulltext
from tessera.sources.store import Store, materialize
from tessera.streaming import harvest

STAGES = ("source", "filter", "extract", "score", "deliver")


@dataclass
class Inputs:
    """What comes from outside: harvested papers, enrichment, fetched bodies, recorded answers."""

    harvested: DataFrame | None = None
    citations: DataFrame | None = None
    open_works: DataFrame | None = None
    tei: DataFrame | None = None
    html: DataFrame | None = None
    answers: DataFrame | None = None
    model: Callable[[], models.Client] | None = None  # makes clients, in place of the configured provider
    fetch: Callable | None = None  # bodies of papers by a request; None where nothing is fetched
    requests: list[DataFrame] = field(default_factory=list)  # filled by a planning run


class Pipeline:
    def __init__(self, store: Store, config: Config, now: Column, strict: bool = False):
        self.store, self.config, self.now, self.strict = store, config, now, strict

    def run(self, inputs: Inputs, stages: tuple[str, ...] = STAGES) -> dict[str, int]:
        summary = {name: getattr(self, name)(inputs) for name in stages}
        self.store.log("pipeline", {k: v for k, v in summary.items()}, self.now)
        return summary

    # -------------------------------------------------------------- 1

    def source(self, inputs: Inputs) -> int:
        """Unknown papers, prefiltered and enriched, as SEEN; the cursor moves only when they are in."""
        if inputs.harvested is None:
            return 0

        def prepare(papers: DataFrame) -> DataFrame:
            missing = [f for f in schemas.PAPERS.fields if f.name not in papers.columns]
            papers = papers.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
            if self.config.sourcing.harvest_prefilter:
                papers = filters.keyword_prefilter(papers, F.concat_ws("\n", "title", "abstract"), self.config).where("passed").drop("passed", "score", "matched")
            if inputs.citations is not None and self.config.sourcing.use_semantic_scholar:
                papers = joins.enrich_citations(papers, inputs.citations)
            if inputs.open_works is not None and self.config.sourcing.use_openalex:
                papers = joins.enrich_open(papers, inputs.open_works)
            return papers.withColumns({"created_at": self.now, "updated_at": self.now})

        return harvest.take(self.store, inputs.harvested, prepare)

    # -------------------------------------------------------------- 2

    def _known(self, inputs: Inputs, reqs: DataFrame) -> DataFrame:
        """Recorded answers, and those that the configured model gives to what is not recorded.

        What a model says is kept in the store's ``answers``, so that no later run asks for it again; a given
        recording goes before it."""
        kept = self.store.read("answers")
        answers = kept if inputs.answers is None else inputs.answers.unionByName(kept.join(inputs.answers.select("key"), "key", "left_anti"))
        make = inputs.model or models.factory(self.config)
        if make:
            said = materialize(models.answers(recorded.pending(reqs, answers), make))
            self.store.upsert("answers", said)
            answers = answers.unionByName(said)
        return answers

    def _answers(self, inputs: Inputs, schema: str, reqs: DataFrame) -> DataFrame:
        answers = self._known(inputs, reqs)
        if not self.strict:
            inputs.requests.append(recorded.pending(reqs, answers))
        return recorded.answered(reqs, answers, schema, self.strict)

    def filter(self, inputs: Inputs) -> int:
        papers = self.store.read("papers").where(F.col("status") == schemas.SEEN)
        text = X.title_and_abstract("title", "abstract")
        embed = embedder(self.config)
        embedded = materialize(embed.embed(papers.withColumn("_text", text), "_text").drop("_text"))
        self.store.upsert("embeddings", embedded.select(F.col("arxiv_id").alias("paper_id"), F.lit(embed.name).alias("model"), F.size("vector").alias("dim"), "vector"))
        problem = embed.embed(self.store.spark.range(1).select(F.lit(self.config.problem_statement).alias("_text")), "_text").select("vector")
        seeds = self.store.spark.createDataFrame([(s,) for s in self.config.seed_papers], "paper_id string")
        seeds = problem.unionByName(joins.seed_vectors(self.store.read("embeddings"), seeds).select("vector"))
        # only what keywords, gate and order leave on the shortlist is asked about
        gated = materialize(relevance.gates(embedded, seeds, self.config, relevance.effective_threshold(self.config, embed.name)))
        short = gated.where((F.col("status") == schemas.SEEN) & F.col("place").isNotNull())
        reqs = materialize(recorded.requests(short, recorded.JUDGEMENT, F.col("arxiv_id"), recorded.relevance_prompt(self.config.problem_statement)))
        answers = self._known(inputs, reqs)
        waiting = recorded.pending(reqs, answers)
        if self.strict and (row := waiting.select("key").first()):
            raise recorded.MissingAnswer(row[0])
        told = recorded.answered(reqs, answers, recorded.JUDGEMENT).select(F.col("cache_key").alias("arxiv_id"), "score", "rationale")
        out = materialize(relevance.verdicts(gated, told, self.config))
        inputs.requests.append(waiting)
        self.store.upsert("papers", out.select(*schemas.PAPERS.names), keep=("created_at",))
        counts = aggregates.stage_counters(out, relevant=F.col("status") == schemas.RELEVANT, irrelevant=F.col("status") == schemas.IRRELEVANT, waiting=F.col("status") == schemas.SEEN).first()
        self.store.log("filter", counts.asDict(), self.now)
        return counts["relevant"]

    # -------------------------------------------------------------- 3

    def extract(self, inputs: Inputs) -> int:
        papers = self.store.read("papers").where(F.col("status").isin(schemas.RELEVANT, schemas.EXTRACTED))
        c = self.config.extraction
        tei, html = inputs.tei, inputs.html
        if inputs.fetch is not None:
            tei = inputs.fetch(papers, fulltext.tei_request(c.grobid_url)) if tei is None and c.use_grobid else tei
            html = inputs.fetch(papers, fulltext.html_request) if html is None and c.prefer_html else html
        texts = fulltext.full_texts(papers, self.config, tei, html)
        hashed = materialize(texts.withColumn("section_hash", F.sha1(X.full_text("sections"))))
        todo = papers.join(filters.unchanged(papers, self.store.read("extractions"), hashed).select("arxiv_id"), "arxiv_id", "left_anti")
        rows = hashed.join(todo.select("arxiv_id"), "arxiv_id", "left_semi").select("arxiv_id", F.posexplode("sections").alias("pos", "s")).select("arxiv_id", "pos", "s.*")
        cut = chunking.chunks(rows, "arxiv_id", c.max_chunk_tokens, c.max_chunks, c.limitation_section_patterns)
        one = F.struct(F.col("chunk_index").cast("int").alias("index"), "text", "section", "page")
        listed = materialize(cut.groupBy("arxiv_id").agg(F.array_sort(F.collect_list(one)).alias("chunks")).withColumnRenamed("arxiv_id", "paper_id"))
        asked = todo.join(listed.withColumnRenamed("paper_id", "arxiv_id"), "arxiv_id")
        reqs = recorded.requests(asked, recorded.EXTRACTION, F.col("arxiv_id"), recorded.extraction_prompt(self.config.problem_statement, F.col("chunks")))
        found = materialize(recorded.extraction_rows(self._answers(inputs, recorded.EXTRACTION, reqs), listed, self.now))
        self.store.upsert("extractions", found)
        done = todo.drop("section_hash").join(hashed.select("arxiv_id", "section_hash"), "arxiv_id").join(found.select(F.col("paper_id").alias("arxiv_id")), "arxiv_id", "left_semi")
        self.store.upsert("papers", done.withColumn("status", F.lit(schemas.EXTRACTED)).select(*schemas.PAPERS.names), keep=("created_at",))
        return found.count()

    # -------------------------------------------------------------- 4

    def score(self, inputs: Inputs) -> int:
        ready, missing = joins.extracted(self.store.read("papers"), self.store.read("extractions"))
        ready = materialize(joins.not_scored(ready, self.store.read("backlog")))
        estimates = None
        if self.config.scoring.llm_estimate_effort:
            reqs = recorded.requests(ready, recorded.ESTIMATE, F.col("arxiv_id"), recorded.estimate_prompt(self.config.problem_statement, F.col("extraction")))
            told = self._answers(inputs, recorded.ESTIMATE, reqs).drop("stubbed")
            estimates = told.withColumnRenamed("cache_key", "paper_id")
            ready = ready.join(told.select(F.col("cache_key").alias("arxiv_id")), "arxiv_id", "left_semi")
        scored = score.rice(score.estimate(score.signals(ready, self.now, self.config), self.config, estimates), self.config)
        items = materialize(score.backlog_items(scored, self.now, self.config))
        edges = materialize(graph.dependency_edges(ready, F.col("reference_ids"), F.col("extraction.dependencies_on_other_methods")))
        self.store.upsert("backlog", items, keep=("created_at",))
        self.store.insert_new("dependencies", edges)
        done = ready.join(items.select(F.col("paper_id").alias("arxiv_id")).distinct(), "arxiv_id", "left_semi")
        self.store.upsert("papers", done.withColumn("status", F.lit(schemas.SCORED)).select(*schemas.PAPERS.names), keep=("created_at",))
        counts = self.store.read("backlog").agg(F.count("*").alias("n"), F.count_if("foundational").alias("f")).first()
        n = items.count()
        self.store.log("score", {"created": n, "backlog_size": counts["n"], "foundational": counts["f"], "missing_extraction": missing.count()}, self.now)
        return n

    # -------------------------------------------------------------- 5

    def deliver(self, inputs: Inputs) -> int:
        """Archive lesser copies, then replace ``backlog.md``, ``digest.md`` and ``digest.html``, each whole or not at all."""
        backlog, _ = dedup.dedupe_backlog(self.store.read("backlog"), self.store.read("papers"), self.config.delivery.title_fuzzy_threshold)
        known = self.store.read("backlog").select("id", F.col("status").alias("_was"))
        self.store.upsert("backlog", backlog.join(known, "id").where("status <> _was").drop("_was"))
        items = self.store.read("backlog")
        top = materialize(rank.select_top(items, self.config))
        made = render.digest(items, self.now, self.config)
        out = Path(self.config.delivery.output_dir)
        out.mkdir(parents=True, exist_ok=True)
        spark = self.store.spark
        delivery.deliver(render.backlog_lines(top, self.config), out / "backlog.md")
        delivery.deliver_text(spark, made["markdown"], out / "digest.md")
        if made["html"]:
            delivery.deliver_text(spark, made["html"], out / "digest.html")
        return len(made["top_items"])


def plan(pipeline: Pipeline, inputs: Inputs, stages: tuple[str, ...] = ("filter", "extract", "score")) -> tuple[str, DataFrame | None]:
    """Run on a snapshot of the store until a stage waits for answers: ``(stage, requests)``, or ``("ready", None)``.

    The store itself is not written: give a pipeline over a :meth:`Store.snapshot`."""
    for name in stages:
        inputs.requests.clear()
        getattr(pipeline, name)(inputs)
        for reqs in inputs.requests:
            if reqs.limit(1).count():
                return name, reqs
    return "ready", None


def backfill(store: Store) -> int:
    """Fill the body fields of items that only have a one-piece description; how many changed."""
    items = store.read("backlog")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    changed = items.where((blank("contributions") | blank("applicability")) & ~blank("description"))
    new = materialize(filters.digest_view(changed).select(*items.columns))
    store.upsert("backlog", new)
    return new.count()


def publish(config: Config, folder: str) -> list[str]:
    """Copies of the delivered files in ``folder``, those that are there."""
    out, to = Path(config.delivery.output_dir), Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    found = [f for f in ("backlog.md", "digest.md", "digest.html") if (out / f).exists()]
    for f in found:
        (to / f).write_bytes((out / f).read_bytes())
    return found
