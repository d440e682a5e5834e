"""Traversals of edge tables (s, t): loops of joins whose lineage is cut each round.

A frontier only joins the edges at its nodes; what was visited is taken out by an
anti join. The loops' state is a table, their only driver-side step is to ask
whether a frontier is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphmill.lineage import cut, cut_by
from graphmill.operators.classify import entry_surface


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reach(edges: DataFrame, roots: DataFrame, most_hops: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """root, node, hop: what each root (root, node) reaches along s -> t, with the fewest hops; hop 0 is the start.

    stop (node): nodes whose edges aren't followed.
    """
    edges = cut(edges.select("s", "t").distinct(), "reach-edges")  # once, not once a hop
    start = cut(roots.select("root", "node").distinct().withColumn("hop", F.lit(0)), "reach")
    parts, frontier, hop = [start], start, 0
    while most_hops is None or hop < most_hops:
        hop += 1
        going = frontier if stop is None else frontier.join(stop.select("node"), "node", "left_anti")
        step = going.select("root", F.col("node").alias("s")).join(edges, "s").select("root", F.col("t").alias("node")).distinct()
        frontier = cut(step.join(_union(parts).select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return _union(parts)


#: Rows that meet all rows of their key in one task, in crossed().
BLOCK = 512
#: Hubs are at most so many nodes, with so many pairs of an edge in and an edge out.
MOST_HUBS, LEAST_OF_HUB = 64, 1 << 10


def crossed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined by key, where few keys have very many pairs: left goes in blocks of its rows, right to each block.

    Tasks are dealt by their number, so that small inputs of large results aren't put together.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    a = left.join(blocks, key).withColumn("block", F.pmod(F.xxhash64(*left.columns), F.col("blocks")).cast("int")).drop("blocks")
    b = right.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return a.repartition(parts, key, "block").join(b.repartition(parts, key, "block"), [key, "block"]).drop("block")


def hubs(edges: DataFrame, most: int = MOST_HUBS, least: int = LEAST_OF_HUB) -> DataFrame:
    """node: those that most pairs of distinct edges (s, t) lead through."""
    into = edges.groupBy(F.col("t").alias("node")).agg(F.count(F.lit(1)).alias("a"))
    out = edges.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("b"))
    through = into.join(out, "node").withColumn("through", F.col("a") * F.col("b")).where(F.col("through") >= least)
    return through.orderBy(F.desc("through"), "node").limit(most).select("node")


def _around(edges: DataFrame, central: DataFrame) -> DataFrame:
    """The edges that don't touch central nodes (node)."""
    return edges.join(central.withColumnRenamed("node", "s"), "s", "left_anti").join(central.withColumnRenamed("node", "t"), "t", "left_anti").select("s", "t")


def _by_hub(found: DataFrame, name: str) -> DataFrame:
    """node, name: the hubs of a node with their hops, from reach() of hubs."""
    return cut(found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("root").alias("hub"), "hop"))).alias(name)), "hubs")


def _best(ups: F.Column, downs: F.Column) -> F.Column:
    """hop, hub of the shortest way through a hub of both lists, the smallest hub on ties; null if they share none."""
    ways = F.transform(ups, lambda u: F.transform(F.filter(downs, lambda v: v["hub"] == u["hub"]), lambda v: F.struct((u["hop"] + v["hop"]).alias("hop"), u["hub"].alias("hub"))))
    return F.array_min(F.flatten(ways))


def reach_through(edges: DataFrame, starts: DataFrame, most_hops: int | None = None, most: int = MOST_HUBS, least: int = LEAST_OF_HUB) -> DataFrame:
    """root, node, hop as reach() of each start (node) by itself; edges must hold no cycle.

    A way either leads through a hub or around all. Ways around are traversed; those through
    are put together from the way to a hub and the way from it, and only written: no
    frontier of them is shuffled, made distinct or compared with what was visited.
    """
    edges = cut(edges.select("s", "t").distinct(), "through-edges")
    starts = cut(starts.select("node").distinct(), "through-starts")
    central = cut(hubs(edges, most, least), "hubs")
    alone = starts.select(F.col("node").alias("root"), "node")
    if central.isEmpty():
        return reach(edges, alone, most_hops)
    own = central.select(F.col("node").alias("root"), "node")
    ups = _by_hub(reach(reversed_edges(edges), own, most_hops).join(starts, "node", "left_semi"), "ups").withColumnRenamed("node", "root")
    downs = _by_hub(reach(edges, own, most_hops), "downs")
    plain = reach(_around(edges, central), alone, most_hops).join(ups, "root", "left").join(downs, "node", "left")
    plain = cut(plain.withColumn("best", _best(F.col("ups"), F.col("downs"))).select("root", "node", F.least("hop", "best.hop").alias("hop"), F.col("best").isNotNull().alias("both")), "around")
    up = ups.select("root", F.inline("ups").alias("hub", "up"), F.when(F.size("ups") > 1, F.col("ups")).alias("ups"))
    down = downs.select("node", F.inline("downs").alias("hub", "down"), F.when(F.size("downs") > 1, F.col("downs")).alias("downs"))
    ways = crossed(up, down, "hub").withColumn("hop", F.col("up") + F.col("down"))
    # of several hubs between two nodes, that of the shortest way gives the row
    one = F.when(F.col("ups").isNull() | F.col("downs").isNull(), True).otherwise(_best(F.col("ups"), F.col("downs")) == F.struct("hop", "hub"))
    ways = ways.where(one if most_hops is None else one & (F.col("hop") <= most_hops)).select("root", "node", "hop")
    return plain.select("root", "node", "hop").unionByName(ways.join(plain.where("both").select("root", "node"), ["root", "node"], "left_anti"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("t").alias("s"), F.col("s").alias("t"))


def dependents(edges: DataFrame, roots: DataFrame, most_hops: int | None = None) -> DataFrame:
    """root, node, hop of all that depends on a root, itself left out."""
    return reach(reversed_edges(edges), roots.select(F.col("node").alias("root"), "node"), most_hops).where("hop > 0 and node <> root")


# What an edge of a type weighs in a blast score; others weigh 1.
EDGE_WEIGHTS = {"calls": 1.0, "extends": 1.5, "implements": 1.2, "uses_type": 0.5}


def edge_weight(kind: F.Column) -> F.Column:
    out = F.lit(1.0)
    for name, weight in EDGE_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def blast_scores(symbol_edges: DataFrame) -> DataFrame:
    """target, callers, score: direct callers of each symbol, each once with its first edge's weight."""
    first = symbol_edges.where("source <> target").groupBy("target", "source").agg(F.min_by("edge_type", F.struct("edge_ord", "edge_type")).alias("edge_type"))
    return first.groupBy("target").agg(F.count(F.lit(1)).alias("callers"), F.round(F.sum(edge_weight(F.col("edge_type"))), 6).alias("score"))


def max_blast(symbol_edges: DataFrame) -> DataFrame:
    return blast_scores(symbol_edges).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("max_blast"))


def reach_counts(files: DataFrame, reached: DataFrame) -> DataFrame:
    """node, dependents, value: the share of all files that depends on each."""
    total = F.broadcast(files.agg(F.count(F.lit(1)).alias("total")))
    counts = reached.join(files.select("node"), "node", "left_semi").groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    return files.select("node").join(counts, "node", "left").na.fill(0, ["dependents"]).join(total).select("node", "dependents", (F.col("dependents") / F.col("total")).alias("value"))


def dependent_counts(files: DataFrame, comps: DataFrame, edges: DataFrame) -> DataFrame:
    """node, dependents, value of every file, as reach_counts() of all files, by components (node, comp).

    Members of a component depend on each other and on the same others: pairs are
    made between components alone.
    """
    comps = cut(comps.join(files.select("node"), "node", "left_semi"), "comps")
    sizes = cut(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    dag = condensation(comps, edges).select(F.col("from_comp").alias("s"), F.col("to_comp").alias("t"))
    above = _weight_above(dag, sizes.withColumnRenamed("comp", "node")).withColumnRenamed("node", "comp")
    total = F.broadcast(files.agg(F.count(F.lit(1)).alias("total")))
    counted = comps.join(sizes, "comp").join(above, "comp", "left").withColumn("dependents", F.col("n") - 1 + F.coalesce("above", F.lit(0)))
    return counted.join(total).select("node", "dependents", (F.col("dependents") / F.col("total")).alias("value"))


def _weight_above(dag: DataFrame, sizes: DataFrame, most: int = MOST_HUBS, least: int = LEAST_OF_HUB) -> DataFrame:
    """node, above: the sizes (node, n) of all other nodes that reach a node, summed; dag must hold no cycle.

    Pairs through hubs aren't made: nodes that reach the same hubs are summed first, and
    nodes that the same hubs reach get the same sum.
    """
    dag = cut(dag.select("s", "t").distinct(), "through-edges")
    central = cut(hubs(dag, most, least), "hubs")
    own = central.select(F.col("node").alias("root"), "node")
    hub_list = lambda found, name: cut(found.groupBy("node").agg(F.sort_array(F.collect_list("root")).alias(name)), "hubs")
    ups, downs = hub_list(reach(reversed_edges(dag), own), "ups"), hub_list(reach(dag, own), "downs")
    plain = reach(_around(dag, central), sizes.select(F.col("node").alias("root"), "node")).where("hop > 0")  # root reaches node
    apart = plain.join(ups.withColumnRenamed("node", "root"), "root", "left").join(downs, "node", "left").where(~F.coalesce(F.arrays_overlap("ups", "downs"), F.lit(False)))
    beside = apart.join(sizes.withColumnRenamed("node", "root"), "root").groupBy("node").agg(F.sum("n").alias("n"))
    above = cut(ups.join(sizes, "node").groupBy("ups").agg(F.sum("n").alias("n")), "above").withColumn("hub", F.explode("ups"))
    below = downs.select("downs").distinct().withColumn("hub", F.explode("downs"))
    sums = above.join(below, "hub").select("ups", "downs", "n").distinct().groupBy("downs").agg(F.sum("n").alias("n"))
    itself = central.join(sizes, "node").select("node", (-F.col("n")).alias("n"))
    every = beside.unionByName(downs.join(sums, "downs").select("node", "n")).unionByName(itself)
    return every.groupBy("node").agg(F.sum("n").alias("above")).where("above > 0")


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: what seeds (node) reach in one or two steps, without them."""
    one = seeds.select(F.col("node").alias("s")).join(edges, "s").select(F.col("t").alias("node")).distinct()
    two = one.select(F.col("node").alias("s")).join(edges, "s").select(F.col("t").alias("node"))
    return one.unionByName(two).distinct().join(seeds.select("node"), "node", "left_anti")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that can lie on a cycle or between cycles: ends without a way in or out go, round by round."""
    current = cut(edges.select("s", "t").where("s <> t").distinct(), "trim")
    n = current.count()
    while n:
        inner = current.join(current.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(current.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
        current = cut(inner.select("s", "t"), "trim")
        left = current.count()
        if left == n:
            break
        n = left
    return current


#: Edges that a task takes at once in scc(), on average.
EDGES_OF_TASK = 1 << 18


def _extremes(outs: DataFrame, ins: DataFrame, parts: int) -> DataFrame:
    """node, above, below: the smallest id that reaches a node of the edges and the smallest that it reaches, itself among them.

    outs and ins hold the edges in `parts` buckets by s and by t, so only offers cross a
    shuffle; a node makes them in the round after it got a smaller id. Both ways go together.
    """
    none = F.lit(None).cast(dict(outs.dtypes)["s"])
    offered = lambda down, up: down.unionByName(up).repartition(parts, "node").groupBy("node").agg(F.min("above").alias("a"), F.min("below").alias("b"))
    first = offered(outs.select(F.col("t").alias("node"), F.col("s").alias("above"), none.alias("below")), ins.select(F.col("s").alias("node"), none.alias("above"), F.col("t").alias("below")))
    new = first.withColumn("above", F.col("node")).withColumn("below", F.col("node"))
    while True:
        lower = lambda value, offer: (F.least(value, offer).alias(value), F.coalesce(F.col(offer) < F.col(value), F.lit(False)).alias(f"new_{value}"))
        moved = Observation()
        new = new.select("node", *lower("above", "a"), *lower("below", "b")).observe(moved, F.count_if(F.col("new_above") | F.col("new_below")).alias("n"))
        values = cut_by(new, "node", parts, "extremes")
        if not moved.get["n"]:
            return values.select("node", "above", "below")
        down = values.where("new_above").select(F.col("node").alias("s"), "above").hint("shuffle_hash").join(outs, "s").select(F.col("t").alias("node"), "above", none.alias("below"))
        up = values.where("new_below").select(F.col("node").alias("t"), "below").hint("shuffle_hash").join(ins, "t").select(F.col("s").alias("node"), none.alias("above"), "below")
        new = values.join(offered(down, up).hint("shuffle_hash"), "node", "left")


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp: strongly connected components, named by their smallest node.

    A node whose smallest id above is its smallest below is in that id's component, as
    all members are then. Of the rest only edges between nodes of equal ids above and
    below can be on a cycle; what trimming leaves of them is taken again.
    """
    settled, rest = [], cut(edges.select("s", "t").where("s <> t"), "scc-edges")
    while n := rest.count():
        parts = n // EDGES_OF_TASK + 1
        outs = cut_by(rest.repartition(parts, "s").distinct(), "s", parts, "outs")
        ins = cut_by(outs.repartition(parts, "t"), "t", parts, "ins")
        ends = _extremes(outs, ins, parts)
        settled.append(ends.where("above = below").select("node", F.col("above").alias("comp")))
        open_ends = ends.where("above <> below")
        inside = open_ends.withColumnRenamed("node", "s").hint("shuffle_hash").join(outs, "s").join(open_ends.withColumnRenamed("node", "t"), ["t", "above", "below"]).select("s", "t")
        rest = trimmed(inside)
    everyone = nodes.select("node").distinct()
    if not settled:
        return everyone.select("node", F.col("node").alias("comp"))
    known = _union(settled)
    return everyone.join(known, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def condensation(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """from_comp, to_comp: distinct edges between components."""
    placed = edges.join(comps.select(F.col("node").alias("s"), F.col("comp").alias("from_comp")), "s").join(comps.select(F.col("node").alias("t"), F.col("comp").alias("to_comp")), "t")
    return placed.where("from_comp <> to_comp").select("from_comp", "to_comp").distinct()


def cycles(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """cycle, node: members of components of several nodes, and nodes with an edge to themselves."""
    large = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp")
    members = comps.join(large, "comp").select(F.col("comp").alias("cycle"), "node")
    loops = edges.where("s = t").select(F.col("s").alias("cycle"), F.col("s").alias("node"))
    return members.unionByName(loops).distinct()


def circular_edges(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """s, t, circular: whether both ends share a component; edges are distinct."""
    e = edges.select("s", "t").distinct()
    placed = e.join(comps.select(F.col("node").alias("s"), F.col("comp").alias("a")), "s", "left").join(comps.select(F.col("node").alias("t"), F.col("comp").alias("b")), "t", "left")
    return placed.select("s", "t", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("circular"))


def circular_neighbors(marked: DataFrame) -> DataFrame:
    """node, neighbor along circular edges, both ways."""
    c = marked.where("circular and s <> t")
    return c.select(F.col("s").alias("node"), F.col("t").alias("neighbor")).unionByName(c.select(F.col("t").alias("node"), F.col("s").alias("neighbor"))).distinct()


def neighbor_sides(marked: DataFrame, node: object) -> DataFrame:
    """neighbor, side of one node by edges (s, t, circular): circular if an edge between the two is, else up, down or both."""
    near = marked.where(((F.col("s") == node) | (F.col("t") == node)) & (F.col("s") != F.col("t")))
    sided = near.select(F.when(F.col("s") == node, F.col("t")).otherwise(F.col("s")).alias("neighbor"), F.when(F.col("t") == node, 1).otherwise(2).alias("bit"), "circular")
    bits = sided.groupBy("neighbor").agg(F.bit_or("bit").alias("bits"), F.bool_or("circular").alias("circular"))
    return bits.select("neighbor", F.when(F.col("circular"), "circular").when(F.col("bits") == 1, "up").when(F.col("bits") == 2, "down").otherwise("both").alias("side"))


def neighbor_partition(edges: DataFrame, node: int) -> DataFrame:
    """neighbor, side: up, down or both of one node."""
    up = edges.where(F.col("t") == node).select(F.col("s").alias("neighbor"), F.lit(1).alias("bit"))
    down = edges.where(F.col("s") == node).select(F.col("t").alias("neighbor"), F.lit(2).alias("bit"))
    bits = up.unionByName(down).groupBy("neighbor").agg(F.bit_or("bit").alias("bits"))
    return bits.select("neighbor", F.when(F.col("bits") == 1, "up").when(F.col("bits") == 2, "down").otherwise("both").alias("side"))


def bridge_sources(nodes: DataFrame, every: int = 100) -> DataFrame:
    """The sample of nodes whose shortest paths stand for all: ids divisible by `every`; 1 takes all nodes."""
    return nodes.where(F.col("node") % every == 0).select("node").distinct()


#: Sources in a word of bits.
WORD = 64


def _words(sources: DataFrame) -> DataFrame:
    """word, node, bits: each source (node) as a bit of a word of up to 64 neighbours in the order of ids."""
    numbered = sources.select("node").orderBy("node").withColumn("k", F.monotonically_increasing_id())
    return cut(numbered.selectExpr("(shiftright(k, 33) << 27) | shiftright(k & 8589934591, 6) AS word", "node", "shiftleft(1L, CAST(k & 63 AS INT)) AS bits"), "bridges")


def _levels(edges: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """By hop from 1: word, node, parent, bits of what the sources (node) reach, through the smallest predecessor.

    The sources of a word go together, a row for all that pass the same edge.
    """
    start = _words(sources)
    seen, frontier, levels = [start], start, []
    earlier = Window.partitionBy("word", "node").orderBy(F.col("parent").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        step = frontier.withColumnRenamed("node", "s").join(edges, "s").select("word", F.col("t").alias("node"), F.col("s").alias("parent"), "bits")
        # what was seen comes first, then predecessors from the smallest: each takes the sources that none before it has
        known = _union(seen).select("word", "node", F.lit(None).cast(dict(edges.dtypes)["s"]).alias("parent"), "bits")
        taken = F.coalesce(F.bit_or("bits").over(earlier), F.lit(0).cast("long"))
        fresh = step.unionByName(known).withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(taken))).where("parent IS NOT NULL AND bits <> 0")
        level = cut(fresh, "bridges")
        if level.isEmpty():
            return levels
        levels.append(level)
        frontier = cut(level.groupBy("word", "node").agg(F.bit_or("bits").alias("bits")), "bridges")
        seen.append(frontier)


def _sizes(level: DataFrame, below: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """level with the size of the subtree of each source's bit, 0 where the bit isn't set."""
    names = [f"c{k}" for k in range(WORD)]
    if below is not None:
        level = level.join(below, ["word", "node"], "left")
    size = lambda k: "1" if below is None else f"1 + coalesce(c{k}, 0)"
    return level.selectExpr("word", "node", "parent", *(f"IF(shiftright(bits, {k}) & 1 = 1, CAST({size(k)} AS BIGINT), 0L) AS c{k}" for k in range(WORD))), names


#: Edges of a graph that a task of _bridges_at_hand() holds; larger ones are traversed as tables.
MOST_AT_HAND = 1 << 23
#: Edges that are followed at once there.
FOLLOWED = 1 << 20


class _Graph:
    """Edges by their ends' places in the order of ids, those of a node side by side."""

    def __init__(self, files: list[str]) -> None:
        ends = [[], []]
        for file in files:
            store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", file))
            part = pq.read_table(inner, filesystem=store, columns=["s", "t"])
            for own, name in zip(ends, ("s", "t"), strict=True):
                own.append(part.column(name).to_numpy())
        s, t = (np.concatenate(own) for own in ends)
        self.ids = np.unique(np.concatenate([np.unique(s), np.unique(t)]))
        s, t = (np.searchsorted(self.ids, x).astype(np.int32) for x in (s, t))
        order = np.argsort(s, kind="stable")
        self.s, self.t = s[order], t[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(self.ids)))])
        self.passed = np.zeros(len(self.s), np.int64)
        self.by = np.zeros(len(self.ids), np.int32)  # the edge that last reached a node

    def add(self, source: int) -> None:
        """Adds to each edge in how many of the source's shortest paths it lies, each through the smallest predecessors."""
        root = int(np.searchsorted(self.ids, source))
        if root == len(self.ids) or self.ids[root] != source:
            return
        seen = np.zeros(len(self.ids), bool)
        seen[root] = True
        frontier, levels = np.array([root]), []
        while len(frontier):
            degrees = self.first[frontier + 1] - self.first[frontier]
            ends = np.cumsum(degrees)
            taken, i = [], 0
            while i < len(frontier):  # from the smallest predecessor, some edges at once: who comes first has the node
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + FOLLOWED, "right")))
                own = degrees[i:j]
                edges = np.repeat((self.first[frontier[i:j]] - np.cumsum(own) + own).astype(np.int32), own) + np.arange(own.sum(), dtype=np.int32)
                nodes = self.t[edges]
                fresh = ~seen[nodes]
                edges, nodes = edges[fresh], nodes[fresh]
                self.by[nodes[::-1]] = edges[::-1]  # the last one assigned stays
                taken.append(edges[self.by[nodes] == edges])
                seen[nodes] = True
                i = j
            edges = np.concatenate(taken)
            frontier = np.sort(self.t[edges])
            levels.append(edges)
        below = np.ones(len(self.ids), np.int64)
        for edges in reversed(levels):
            sizes = below[self.t[edges]]
            self.passed[edges] += sizes
            np.add.at(below, self.s[edges], sizes)


def _bridges_at_hand(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """s, t, betweenness as bridge_edges(), of distinct edges by whole numbers that were cut(): a task reads all edges, takes its sources one by one and gives a row for each edge they pass."""
    files = edges.inputFiles()
    kind = dict(edges.dtypes)["s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for source in batch.column(0).to_pylist():
                graph = graph or _Graph(files)
                graph.add(source)
        if graph:
            passed = np.flatnonzero(graph.passed)
            for k in range(0, len(passed), 1 << 16):
                own = passed[k : k + (1 << 16)]
                ends = [pa.array(graph.ids[x[own]], pa.int64()).cast(pa.int32() if kind == "int" else pa.int64()) for x in (graph.s, graph.t)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(graph.passed[own])], names=["s", "t", "betweenness"])

    tasks = max(1, sources.sparkSession.sparkContext.defaultParallelism)  # the edges are read by each
    dealt = sources.where("node IS NOT NULL").select("node").repartition(tasks)
    part = dealt.mapInArrow(run, f"s {kind}, t {kind}, betweenness bigint")
    return part.groupBy("s", "t").agg(F.sum("betweenness").alias("betweenness"))


def bridge_edges(sources: DataFrame, edges: DataFrame, top: int | None = 20, blocks: int = 1) -> DataFrame:
    """s, t, betweenness: in how many shortest paths from the sources (node) the edge lies, one path per source and node.

    The path goes through the smallest predecessor at each step. Counts are sizes
    of subtrees, summed from the deepest level up, for the sources of a word at once. With all nodes as sources the
    result is exact, with a sample (bridge_sources) it estimates that, divided by the
    sample's rate. What is held on the way is sources times nodes; with blocks, the
    sources are taken in so many parts, one after the other, and only their running
    total, a row for each edge at most, is kept. A graph of at most MOST_AT_HAND edges between
    whole numbers is held by each task instead, and nothing by source and node is written.
    """
    edges = cut(edges.select("s", "t").distinct(), "bridges-edges")
    if {kind for _, kind in edges.dtypes} <= {"int", "bigint"} and len(set(dict(edges.dtypes).values())) == 1:
        n = edges.agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("s"), F.count("t").alias("t")).first()
        if 0 < n["n"] <= MOST_AT_HAND and n["s"] == n["t"] == n["n"]:
            total = _bridges_at_hand(sources.select("node").distinct(), edges)
            return total if top is None else total.orderBy(F.desc("betweenness"), "s", "t").limit(top)
    sources = cut(sources.select("node").distinct(), "bridges-sources") if blocks > 1 else sources.select("node").distinct()
    total = None
    for block in range(blocks):
        own = sources if blocks == 1 else sources.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
        below, counted = None, []
        for level in reversed(_levels(edges, own)):
            sized, names = _sizes(level, below)
            counted.append(sized.select(F.col("parent").alias("s"), F.col("node").alias("t"), F.expr(" + ".join(names)).alias("betweenness")))
            below = cut(sized.groupBy("word", F.col("parent").alias("node")).agg(*(F.sum(c).alias(c) for c in names)), "bridges")
        if counted:
            part = _union([cut(x.groupBy("s", "t").agg(F.sum("betweenness").alias("betweenness")), "bridges") for x in counted])
            every = part if total is None else part.unionByName(total)
            total = every.groupBy("s", "t").agg(F.sum("betweenness").alias("betweenness"))
            total = cut(total, "bridges-total") if blocks > 1 else total
    if total is None:
        return edges.select("s", "t", F.lit(0).cast("long").alias("betweenness")).limit(0)
    return total if top is None else total.orderBy(F.desc("betweenness"), "s", "t").limit(top)


#: Pairs of source and node that bridge_edges() holds at once, by default of bridge_blocks().
PAIRS = 1 << 27


def bridge_blocks(sources: int, nodes: int, pairs: int = PAIRS) -> int:
    return max(1, -(-sources * nodes // pairs))


def seams(bridges: DataFrame, comps: DataFrame, pairs: DataFrame, n_nodes: int, top: int = 10) -> DataFrame:
    """s, t, betweenness, avg_coupling, score of bridges (s, t, betweenness) between components.

    pairs: file_a, file_b, confidence. The mean covers the pairs present between the
    two components; only scores over 30 count.
    """
    a = comps.select(F.col("node").alias("s"), F.col("comp").alias("a"))
    b = comps.select(F.col("node").alias("t"), F.col("comp").alias("b"))
    crossing = bridges.join(a, "s").join(b, "t").where("a <> b")
    placed = pairs.join(comps.select(F.col("node").alias("file_a"), F.col("comp").alias("x")), "file_a").join(comps.select(F.col("node").alias("file_b"), F.col("comp").alias("y")), "file_b")
    mean = placed.groupBy(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).agg(F.avg("confidence").alias("mean"))
    joined = crossing.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).join(mean, ["low", "high"], "left")
    coupled = F.coalesce("mean", F.lit(0.0))
    raw = F.least(F.lit(100.0), F.col("betweenness") / max(1, n_nodes) * 100) * 0.7 + F.greatest(F.lit(0.0), 1 - coupled) * 30
    scored = joined.select("s", "t", "betweenness", F.round(coupled, 9).alias("avg_coupling"), F.floor(raw + 0.5).alias("score"))
    return scored.where("score > 30").orderBy(F.desc("score"), "s", "t").limit(top)


def flow_entries(classified: DataFrame) -> DataFrame:
    """node, path of entry, route and controller files that aren't documents; runtime ones only, if there are any."""
    fit = classified.where(F.col("category").isin("entry", "route", "controller") & ~F.lower("path").rlike(r"\.(md|json|yaml|yml|toml)$")).select("node", "path", entry_surface(F.col("path")).alias("surface"))
    fit = cut(fit, "entries")  # read twice below
    some = F.broadcast(fit.agg(F.coalesce(F.bool_or(F.col("surface") == "runtime"), F.lit(False)).alias("some")))
    return fit.join(some).where(~F.col("some") | (F.col("surface") == "runtime")).select("node", "path")


def flows(entries: DataFrame, comps: DataFrame, layers: DataFrame, edges: DataFrame, most_depth: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, anomalies, capped) from entries (node), comps, layers (node, layer) and edges.

    steps: entry, comp, hop, layer; a component's layer is its smallest positive one.
    anomalies: entry, from_comp, to_comp, direction of the edges it follows or ends
    at. capped: entry, for traces that the depth ends. Breadth first: unlike depth
    first search, the cap hides no component that a shorter path reaches.
    """
    comps = cut(comps.select("node", "comp"), "flows")  # read four times below
    joined = comps.join(layers, "node", "left")
    lead = F.coalesce(F.min(F.when(F.col("layer") > 0, F.col("layer"))), F.min_by(F.coalesce("layer", F.lit(-1)), "node"))
    layer = cut(joined.groupBy("comp").agg(lead.alias("layer")), "flows")
    dag = cut(condensation(comps, edges).select(F.col("from_comp").alias("s"), F.col("to_comp").alias("t")), "flows")
    start = cut(entries.select("node").distinct().join(comps, "node").select(F.col("node").alias("entry"), F.col("comp").alias("root")), "flows")
    ends = layer.where("layer in (4, 5)").select(F.col("comp").alias("s"))
    open_dag = dag.join(ends, "s", "left_anti")
    # entries of one component pass the same components: a trace is made once for each, and rows of entries last
    found = cut(reach_through(open_dag, start.select(F.col("root").alias("node")), most_depth), "flows")
    passed = found.where(F.col("hop") < most_depth).select("root", F.col("node").alias("comp"), "hop")
    steps = crossed(start, passed.join(layer, "comp"), "root").select("entry", "comp", "hop", "layer")
    a, b = layer.select(F.col("comp").alias("s"), F.col("layer").alias("a")), layer.select(F.col("comp").alias("t"), F.col("layer").alias("b"))
    marked = dag.join(a, "s").join(b, "t").where("a not in (4, 5)").withColumn("direction", F.when(F.col("b") < F.col("a"), "backward").when(F.col("b") - F.col("a") >= 3, "skip-layer")).where("direction is not null")
    anomalies = crossed(start, passed.join(marked, F.col("comp") == F.col("s")).select("root", "s", "t", "direction"), "root").select("entry", F.col("s").alias("from_comp"), F.col("t").alias("to_comp"), "direction")
    capped = start.join(found.where(F.col("hop") == most_depth).select("root"), "root", "left_semi").select("entry")
    return steps, anomalies, capped


def flow_edges(steps: DataFrame) -> DataFrame:
    """source, target: consecutive steps (entry, pos, file) of all flows, each once."""
    w = Window.partitionBy("entry").orderBy("pos")
    return steps.withColumn("target", F.lead("file").over(w)).where("target is not null and target <> file").select(F.col("file").alias("source"), "target").distinct()


def flow_merge(steps: DataFrame) -> DataFrame:
    """entry, file, seq, pos: the steps (entry, seq, pos, file) of all traces of an entry as one, each file where it comes first."""
    first = steps.groupBy("entry", "file").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return first.select("entry", "file", "at.seq", "at.pos")


def with_cycle_members(selected: DataFrame, comps: DataFrame) -> DataFrame:
    """node: selected nodes (node) and all members (node, comp) of cycles that one of them is on."""
    large = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp")
    touched = comps.join(large, "comp", "left_semi").join(selected.select("node"), "node", "left_semi").select("comp").distinct()
    return selected.select("node").unionByName(comps.join(touched, "comp", "left_semi").select("node")).distinct()


def _folders(path: F.Column) -> F.Column:
    """All leading segments of a path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def federation_edges(edges: DataFrame, sisters: DataFrame, aliases: DataFrame, root: str) -> DataFrame:
    """source, target, repo, rule of import edges (source, target) into sister repositories; the first rule that fits.

    sisters: name, path, package; aliases: prefix, base. Rule 1: a relative path that
    leaves the repository; 2: a sister's package name; 3: a path alias outside.
    Paths are listed by their folders, so all rules are equi joins.
    """
    from graphmill.functions.columns import dirname, fold_dots, package_name

    full = F.concat(F.lit("/"), fold_dots(F.concat_ws("/", F.lit(root), dirname(F.col("source")), F.col("target"))))
    repos = sisters.select(F.col("path").alias("folder"), F.col("name").alias("repo"))
    relative = edges.where(F.col("target").startswith("../")).select("source", "target", F.explode(_folders(full)).alias("folder"))
    one = relative.join(repos, "folder").select("source", "target", "repo", F.lit(1).alias("rule"))
    two = edges.withColumn("package", package_name(F.col("target"))).join(sisters.select("package", F.col("name").alias("repo")), "package").select("source", "target", "repo", F.lit(2).alias("rule"))
    outside = aliases.select("prefix", F.explode(_folders(F.col("base"))).alias("folder")).join(repos, "folder").select("prefix", "repo")
    three = edges.select("source", "target", F.explode(_folders(F.col("target"))).alias("prefix")).join(outside, "prefix").select("source", "target", "repo", F.lit(3).alias("rule"))
    every = one.unionByName(two).unionByName(three)
    return every.groupBy("source", "target").agg(F.min(F.struct("rule", "repo")).alias("b")).select("source", "target", "b.repo", "b.rule")
