"""Command line: ``python -m tessera.plans.cli COMMAND --config FILE``."""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import config as C
from tessera import schemas
from tessera.functions.text import category_query
from tessera.operators import aggregates, joins, rank
from tessera.plans import render, stages
from tessera.sources import atom, jsonl, services
from tessera.sources.http import HttpClient
from tessera.sources.store import Store, materialize
from tessera.streaming import harvest


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("command", choices=["init", *stages.STAGES, "run", "batch-plan", "batch-apply", "backlog", "status", "backfill", "publish"])
    p.add_argument("--config", required=True)
    p.add_argument("--feed", help="Atom files to harvest instead of the network")
    p.add_argument("--answers", help="recorded answers, JSON lines")
    p.add_argument("--offline", action="store_true", help="no citation services and no full texts (so with --feed, too)")
    p.add_argument("--to", default="pages", help="folder that publish copies to")
    p.add_argument("--since", help="ISO date; no zone means UTC")
    p.add_argument("-n", type=int, default=25)
    a = p.parse_args(argv)
    cfg = C.load(a.config)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, cfg.storage.path)
    now = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    if a.command == "init":
        for name, schema in schemas.TABLES.items():
            store.replace(name, spark.createDataFrame([], schema))
        return
    if a.command == "status":
        for row in aggregates.status_counts(store.read("papers")).orderBy("status").collect():
            print(f"{row['status']}: {row['n']}")
        print(f"NEW items: {store.read('backlog').where(F.col('status') == schemas.NEW).count()}")
        return
    if a.command == "backfill":
        print(stages.backfill(store))
        return
    if a.command == "publish":
        print(" ".join(stages.publish(cfg, a.to)))
        return
    if a.command == "backlog":
        print(render.backlog_markdown(rank.plain_top(store.read("backlog"), a.n), cfg))
        return
    inputs = stages.Inputs(answers=jsonl.read_answers(spark, a.answers) if a.answers else None)
    if a.command in ("source", "run"):
        if a.feed:
            inputs.harvested = atom.read_files(spark, a.feed)
        else:
            spark.dataSource.register(atom.PreprintSource)
            options = {"categories": ",".join(cfg.sourcing.arxiv_categories), "maxResults": str(cfg.sourcing.max_results_per_run), "pageSize": str(cfg.sourcing.page_size), "timeout": str(cfg.sourcing.request_timeout_s)}
            print("query:", category_query(cfg.sourcing.arxiv_categories))
            since = a.since or store.get_state(harvest.CURSOR)  # the source itself leaves out what an earlier harvest has seen
            inputs.harvested = atom.papers(spark.read.format("preprints").options(**options, **({"since": since} if since else {})).load())
    online = not (a.offline or a.feed)
    if online and inputs.harvested is not None:
        inputs.harvested = materialize(inputs.harvested)  # asked for once, however often it is read
        new = joins.new_rows(inputs.harvested, store.read("papers"))
        client = lambda: HttpClient(timeout=cfg.sourcing.request_timeout_s)
        if cfg.sourcing.use_semantic_scholar:
            inputs.citations = materialize(services.citations(services.fetch(new, services.citation_request, client)))
        if cfg.sourcing.use_openalex:
            inputs.open_works = materialize(services.open_works(services.fetch(new, services.open_request, client)))
    if online and a.command in ("extract", "run", "batch-plan", "batch-apply"):
        inputs.fetch = lambda papers, request: materialize(services.fetch(papers, request, lambda: HttpClient(timeout=cfg.sourcing.request_timeout_s)))
    if a.command == "batch-plan":
        scratch = store.snapshot(f"{cfg.storage.path}-plan-{uuid.uuid4().hex}")
        stage, reqs = stages.plan(stages.Pipeline(scratch, cfg, now), inputs)
        if reqs is not None:
            jsonl.write_requests(reqs, f"{cfg.llm.batch_dir}/requests")
        scratch.drop()
        print(json.dumps({"stage": stage}))
        return
    if a.command == "batch-apply":
        print(json.dumps(stages.Pipeline(store, cfg, now, strict=True).run(inputs, ("filter", "extract", "score", "deliver"))))
        jsonl.clear_requests(spark, f"{cfg.llm.batch_dir}/requests")
        return
    wanted = stages.STAGES if a.command == "run" else (a.command,)
    print(json.dumps(stages.Pipeline(store, cfg, now).run(inputs, wanted)))


if __name__ == "__main__":
    main()
