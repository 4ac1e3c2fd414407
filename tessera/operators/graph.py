"""Edges, components and topological order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.rank import global_rank
from tessera.sources.store import Store, materialize

#: Beyond any sum along a path: the value of what is in or behind a cycle.
_LOST = 1 << 60
MAX_CITATION_EDGES = 50


def dependency_edges(papers: DataFrame, references: Column, dependencies: Column, id_: str = "arxiv_id") -> DataFrame:
    """``src, dst, source, paper_id``: the first references and all named dependencies; no blanks, loops or repeats."""

    def edges(targets: Column, source: str) -> DataFrame:
        rows = papers.select(F.col(id_).alias("src"), F.explode(F.transform(targets, lambda x: F.trim(x))).alias("dst"))
        return rows.where("dst <> '' and dst <> src").distinct().select("src", "dst", F.lit(source).alias("source"), F.col("src").alias("paper_id"))

    return edges(F.slice(references, 1, MAX_CITATION_EDGES), "citation").unionByName(edges(dependencies, "extracted"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root``: the least node that each node of an undirected edge set reaches.

    Labels spread to neighbours and then jump to their label's label, so rounds grow
    with the logarithm of a chain's length.  Each round is kept in shared storage."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialize(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        spread = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = spread.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialize(spread.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


class Components:
    """Components of a growing edge set: harvests add edges, and only the components that they touch change.

    ``nodes`` holds each node with its component as of its first harvest and is only added to; ``moved`` holds
    what became of components that were joined with others.  New edges are looked up in both and so become edges
    between components, whose own components are the new ones."""

    def __init__(self, spark: SparkSession, path: str, kind: T.DataType | None = None, buckets: int = 64):
        """``kind``: the type of nodes, long if not given."""
        two = lambda a, b: T.StructType([T.StructField(x, kind or T.LongType()) for x in (a, b)])
        self.store = Store(spark, path, {"nodes": two("node", "first"), "moved": two("first", "root")}, {"nodes": ["node"], "moved": ["first"]}, buckets)

    def roots(self, nodes: DataFrame) -> DataFrame:
        """``node, root`` for the known ones of ``nodes``; only their buckets are read."""
        known = self.store.near("nodes", nodes).join(nodes.select("node").distinct(), "node", "left_semi")
        known = materialize(known)
        return known.join(self.store.near("moved", known).hint("merge"), "first", "left").select("node", F.coalesce("root", "first").alias("root"))

    def add(self, edges: DataFrame, a: str = "a", b: str = "b") -> int:
        """Take in the edges; how many components were joined to another or are new."""
        one = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
        ends = materialize(one.select(F.col("a").alias("node")).union(one.select("b")).distinct())
        known = materialize(self.roots(ends))
        side = lambda end, name: known.select(F.col("node").alias(end), F.col("root").alias(name))
        met = one.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        joined = components(met)  # of components, old and new
        new = ends.join(known, "node", "left_anti").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("first"))
        changed = materialize(joined.where("node <> root").select(F.col("node").alias("old"), "root"))
        # components that were joined before into one that is now joined to another
        again = self.store.read("moved").join(changed.withColumnRenamed("root", "to"), F.col("root") == F.col("old")).select("first", F.col("to").alias("root"))
        old = known.select(F.col("root").alias("old")).distinct()
        now = materialize(changed.join(old, "old", "left_semi").select(F.col("old").alias("first"), "root").unionByName(again))
        self.store.upsert("moved", now)
        self.store.append("nodes", new)
        return changed.count()

    def read(self) -> DataFrame:
        """``node, root`` of all nodes."""
        return self.store.read("nodes").join(self.store.read("moved"), "first", "left").select("node", F.coalesce("root", "first").alias("root"))


def inside(edges: DataFrame, nodes: DataFrame, id_: str = "id") -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select(id_).distinct()
    return edges.where("src <> dst").join(n.withColumnRenamed(id_, "src"), "src", "left_semi").join(n.withColumnRenamed(id_, "dst"), "dst", "left_semi")


def led(key: Column, path: Column) -> Column:
    """The key of what builds on ``key`` by way of ``path``: both are descending lists; what of the key is less than the path's first leaves."""
    return F.concat(F.filter(key, lambda x: x > F.get(path, F.lit(0))), path)


def propagate(rows: DataFrame, most: int) -> DataFrame:
    """``id, value``: the greatest of a node's constants and of ``w`` plus the value of each node ``dst`` that it points to.

    ``rows`` are ``src, dst, w``, with a null ``dst`` for a constant; every node has one.  ``value`` is null in or behind
    a cycle.  In each round a node takes up the values of settled nodes, and looks through nodes that point to one
    node only: what these point to takes their place, so paths through them double and a chain takes rounds by the
    logarithm of its length.  Other nodes take a round for each node on the longest path that is left.  ``most``
    bounds the sum of ``w`` over a path without cycles; what exceeds it has gone round one.

    If ``rows`` have ``path`` too, so has the result: the greatest of a node's constant paths and of those of the nodes that
    it points to, each :func:`led` by the link's.  In or behind a cycle it means nothing."""
    lost = F.lit(_LOST)
    paths = "path" in rows.columns
    also = lambda *names: [F.col(x) for x in names if paths]
    state, before, found = materialize(rows.select("src", "dst", F.col("w").cast("long").alias("w"), *also("path"))), None, []
    while True:
        no, yes = F.col("dst").isNull(), F.col("dst").isNotNull()
        parts = [F.max(F.when(no, F.col("path"))).alias("cp"), F.max(F.when(yes, F.col("path"))).alias("bp")] if paths else []
        info = state.groupBy("src").agg(F.count("dst").alias("k"), F.max(F.when(no, F.col("w"))).alias("c"), F.max("dst").alias("to"), F.max(F.when(yes, F.col("w"))).alias("by"), *parts)
        if paths:  # sorted and put together once a round
            info = materialize(info)
        found.append(info.where("k = 0").select(F.col("src").alias("id"), F.col("c").alias("value"), *[x.alias("path") for x in also("cp")]))
        if len(found) == 16:  # keeps the plan short
            found = [materialize(reduce(DataFrame.unionByName, found))]
        # a node that points to a settled one only is as good as settled; nothing may be led to a node that leaves now
        ends = info.where("k = 0").select(F.col("src").alias("to"), F.when(F.col("c") >= lost, lost).otherwise(F.col("c")).alias("end"), *[x.alias("ep") for x in also("cp")])
        seen = info.where("k < 2").join(ends, "to", "left")
        ended = F.col("end").isNotNull()
        value = F.when(ended, F.greatest("c", F.least(F.col("end") + F.col("by"), lost))).otherwise(F.col("c"))
        path = [F.when(ended, F.greatest(x, led(F.col("ep"), F.col("bp")))).otherwise(x).alias("cp") for x in also("cp")]
        seen = seen.select(F.col("src").alias("dst"), F.when(ended, 0).otherwise(F.col("k")).alias("k"), value.alias("c"), "to", "by", *path, *also("bp"))
        met = state.where("dst is not null").join(seen, "dst", "left")
        step = lambda dst, w, by: F.struct(dst.alias("dst"), w.alias("w"), *[(x if by is None else led(F.col(by), x)).alias("path") for x in also("path")])
        none = F.lit(None).cast(state.schema["dst"].dataType)
        known = F.when(F.col("c") >= lost, lost).otherwise(F.col("w") + F.col("c"))
        through = F.when(F.col("k") == 1, step(F.col("to"), F.col("w") + F.col("by"), "bp")).when(F.col("k").isNull(), step(F.col("dst"), F.col("w"), None))
        steps = F.array_compact(F.array(F.when(F.col("c").isNotNull(), step(none, known, "cp")), through))
        moved = met.select("src", F.explode(steps).alias("x")).select("src", "x.*")
        round_ = F.col("dst").isNotNull() & (F.col("w") > most)
        moved = moved.select("src", F.when(~round_, F.col("dst")).alias("dst"), F.when(round_, lost).otherwise(F.col("w")).alias("w"), *also("path"))
        kept = info.where("k > 0 and c is not null").select("src", none.alias("dst"), F.col("c").alias("w"), *[x.alias("path") for x in also("cp")])
        state = materialize(moved.unionByName(kept).groupBy("src", "dst").agg(F.max("w").alias("w"), *[F.max(x).alias("path") for x in also("path")]))
        links, *now = state.agg(F.count("dst"), F.count("*"), F.sum(F.xxhash64("src", "dst", "w").cast("decimal(38,0)"))).first()
        if not links or now == before:
            break
        before = now
    rest = state.groupBy("src").agg(F.count("dst").alias("k"), F.max("w").alias("value"), *[F.max(x).alias("path") for x in also("path")])
    found.append(rest.select(F.col("src").alias("id"), F.when(F.col("k") == 0, F.col("value")).otherwise(lost).alias("value"), *also("path")))
    # what was lost on the way, or stands still in a cycle, has the greatest value
    out = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("value").alias("value"), *[F.max(x).alias("path") for x in also("path")])
    return materialize(out.select("id", F.when(F.col("value") < lost, F.col("value")).alias("value"), *also("path")))


def topological_levels(nodes: DataFrame, edges: DataFrame, id_: str = "id") -> DataFrame:
    """``id_, level``: 0 without dependencies, else one more than the deepest; null for what is in or behind a cycle.

    Sorting by level gives a valid order of any number of nodes."""
    one = nodes.select(F.col(id_).alias("src")).distinct()
    links = inside(edges, nodes, id_).select("src", "dst").distinct()
    core, outer = peeled(links)
    constants = one.join(outer[-1].select("src").hint("merge"), "src", "left_anti") if outer else one
    for layer in outer[:-1]:
        constants = constants.join(layer.select("src").hint("merge"), "src", "left_anti")
    rows = constants.select("src", F.lit(None).cast(links.schema["dst"].dataType).alias("dst"), F.lit(0).alias("w")).unionByName(core.withColumn("w", F.lit(1)))
    found = propagate(rows, one.count())
    for layer in reversed(outer):  # what a layer points to has its level by now
        met = layer.join(found.select(F.col("id").alias("dst"), "value").hint("merge"), "dst", "left").groupBy("src")
        level = F.when(F.count("value") == F.count("*"), F.max("value") + 1)
        found = materialize(found.unionByName(met.agg(level.alias("value")).withColumnRenamed("src", "id")))
    return found.select(F.col("id").alias(id_), F.col("value").cast("int").alias("level"))


def peeled(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The links that a level may wait for, and layers of links of nodes that nothing points to, the outermost first.

    The level of such a node follows in one step from those of the nodes it points to, so it takes part in no round.
    Layers are taken off while each holds most of what is left, so their number grows with the logarithm of the links."""
    outer = []
    while True:
        used = links.select(F.col("dst").alias("src")).distinct().withColumn("_used", F.lit(True))
        marked = links.join(used.hint("merge"), "src", "left")
        n, inner = marked.agg(F.count("*"), F.count("_used")).first()
        if not n or 2 * inner > n:
            return links, outer
        marked = materialize(marked)
        outer.append(marked.where("_used is null").select("src", "dst"))
        links = marked.where("_used").select("src", "dst")


def topological_order(nodes: DataFrame, edges: DataFrame, id_: str = "id", position: str = "position") -> DataFrame:
    """``id_, place`` in the exact order: always the earliest node by ``position`` of those whose dependencies are placed; cycles last.

    Let ``m`` be the latest node among a node and all it builds on.  Nodes of a lesser ``m`` come first, since they never
    wait for a later node.  Of the nodes that share ``m``, this one comes first; the others all build on it, and among
    themselves the same rule holds again, with the dependencies inside the group.  So the nodes' lists of their ``m`` in
    such groups, compared from the left, give the order.  A node's list is the greatest of those of the nodes it points to,
    cut before the first that is earlier than itself, and itself: these cuts add up along a path (:func:`led`), and a
    greater list never leads to a lesser one, so one propagation finds all lists.  No list is longer than a descent of
    positions along a path."""
    first = nodes.groupBy(id_).agg(F.min(position).alias("_at"))
    named = materialize(global_rank(first, [F.asc_nulls_last("_at"), F.asc(id_)], "_n").select(F.col(id_).alias("_id"), "_n"))
    side = lambda end, name: named.select(F.col("_id").alias(end), F.col("_n").alias(name)).hint("merge")
    ends = edges.where("src <> dst").select("src", "dst").distinct()
    links = materialize(ends.join(side("src", "s"), "src").join(side("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")))
    n = named.count()
    core, outer = peeled(links)
    constants = core.select("src").union(core.select("dst")).distinct().select("src", F.lit(None).cast("long").alias("dst"), F.lit(0).alias("w"))
    found = propagate(constants.unionByName(core.withColumn("w", F.lit(1))).withColumn("path", F.array("src")), n)
    lost = F.array(F.lit(n), F.col("src"))  # after all that are placed
    found = found.withColumnRenamed("id", "src").select("src", F.when(F.col("value").isNull(), lost).otherwise(F.col("path")).alias("key"))
    for k, layer in enumerate(reversed(outer), 1):  # what a layer points to has its list by now, or builds on nothing
        met = layer.join(found.withColumnRenamed("src", "dst").hint("merge"), "dst", "left")
        top = met.groupBy("src").agg(F.max(F.coalesce("key", F.array("dst"))).alias("key"))
        keys = top.select("src", F.when(F.get("key", F.lit(0)) == n, lost).otherwise(led(F.col("key"), F.array("src"))).alias("key"))
        found = found.unionByName(keys if k == len(outer) else materialize(keys))
    keyed = named.join(found.withColumnRenamed("src", "_n").hint("merge"), "_n", "left").select("_id", F.coalesce("key", F.array("_n")).alias("key"))
    return global_rank(keyed, [F.asc("key")], "place").select(F.col("_id").alias(id_), "place")
