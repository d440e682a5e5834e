"""Mixing sources to target weights by a min-cost flow.

A document may belong to several sources. Documents with the same sources, a membership
pattern, are one node with the sum of their sizes; capacity flows from patterns to the
quotas of their sources. The first reading of a pattern costs nothing, each further one
a unit more: costs are convex, so nothing is read twice while a pattern that serves the
same quota is unread. The flow tells how many whole readings a pattern gets and how
much of one more.

That part is taken in whole documents, in the order of a seeded hash, by size class
(powers of two): a class is cut where its share of the part ends. The cut is found by
sums over 512 ranges of hashes, then over 512 ranges of the one it lies in, and so on,
never by ordering all documents. What the cuts leave over, less than one document of
each class, is filled with further documents, large ones first.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Hashable, Iterable, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import table

#: Membership patterns that the flow, and what is broadcast for each, is made for; more are an error.
MOST_PATTERNS = 2000
#: Bits of the hash that one step of a cut settles, and rows of a range that are ordered at last.
BITS, FEW = 9, 10_000
#: Documents of a class that may fill what the cuts leave over.
FILLERS = 8


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """`share` of all sizes dealt by weight; none above `most` times its own size, the excess dealt again by weight."""
    out, left, open_ = [Fraction(0)] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        together = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > most * sizes[i] * together}
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else left * weights[i] / together
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def route(capacities: dict[tuple[Hashable, ...], int], quotas: dict[Hashable, int], most_repeats: int = 2) -> dict[tuple[Hashable, ...], int]:
    """Words taken of each pattern (a tuple of sources): a largest flow of least cost from patterns to quotas.

    Successive cheapest paths; the first reading of a pattern costs 0 a word, the next 1, and so on.
    """
    arcs: list[list] = []  # to, room, cost; an arc's reverse has its number with the last bit flipped
    out: dict[Hashable, list[int]] = defaultdict(list)

    def arc(a: Hashable, b: Hashable, room: int, cost: int) -> None:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[u].append(len(arcs))
            arcs.append([v, r, c])

    for k, (pattern, capacity) in enumerate(capacities.items()):
        for reading in range(most_repeats):
            arc("from", ("pattern", k), capacity, reading)
        for source in pattern:
            if source in quotas:
                arc(("pattern", k), ("source", source), most_repeats * capacity, 0)
    for source, quota in quotas.items():
        arc(("source", source), "to", quota, 0)
    while True:
        cost, by, waiting = {"from": 0}, {}, deque(["from"])
        while waiting:
            u = waiting.popleft()
            for number in out[u]:
                v, room, c = arcs[number]
                if room > 0 and cost[u] + c < cost.get(v, 1 << 60):
                    cost[v], by[v] = cost[u] + c, number
                    waiting.append(v)
        if "to" not in by:
            break
        path, v = [], "to"
        while v != "from":
            path.append(by[v])
            v = arcs[by[v] ^ 1][0]
        room = min(arcs[number][1] for number in path)
        for number in path:
            arcs[number][1] -= room
            arcs[number ^ 1][1] += room
    # what stands on the reverse arcs of a pattern's readings is what flows
    flow = dict.fromkeys(capacities, 0)
    patterns = list(capacities)
    for number in out["from"]:
        if number % 2 == 0:
            flow[patterns[arcs[number][0][1]]] += arcs[number ^ 1][1]
    return flow


def _cuts(units: DataFrame) -> DataFrame:
    """part, class, cut: the first hash of a class that isn't taken.

    units: part, class, h, size and portion, the part of a reading to take.
    """
    stratum = ["part", "class"]
    inside, before, level = units, None, 0
    while True:
        level += 1
        shift = max(0, 63 - BITS * level)
        binned = inside.groupBy(*stratum, F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("portion").alias("portion"))
        if before is None:
            own = Window.partitionBy(*stratum)
            binned = binned.withColumn("all", F.sum("size").over(own)).withColumn("left", F.least(F.floor(F.col("portion") * F.col("all")), F.col("all") - 1))
        else:
            binned = binned.join(before.select(*stratum, "left"), stratum)
        ordered = binned.withColumn("end", F.sum("size").over(Window.partitionBy(*stratum).orderBy("bin")))
        here = ordered.where((F.col("end") > F.col("left")) & (F.col("end") - F.col("size") <= F.col("left")))
        before = table(here.select(*stratum, "bin", (F.col("left") - F.col("end") + F.col("size")).alias("left"), "n"), "mixing-bins", True)
        inside = units.withColumn("bin", F.shiftright("h", shift)).join(F.broadcast(before.select(*stratum, "bin")), [*stratum, "bin"]).drop("bin")
        if shift == 0 or (before.agg(F.max("n").alias("n")).first()["n"] or 0) <= FEW:
            break
    # rows that repeat an id and a size have one hash, and are taken or left together
    single = inside.groupBy(*stratum, "h").agg(F.sum("size").alias("size")).join(before.select(*stratum, "left"), stratum)
    ordered = single.withColumn("end", F.sum("size").over(Window.partitionBy(*stratum).orderBy("h")))
    here = ordered.where((F.col("end") > F.col("left")) & (F.col("end") - F.col("size") <= F.col("left")))
    return table(here.select(*stratum, F.col("h").alias("cut")), "mixing-cuts", True)


def _fill(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
    """Large documents first, each that still fits."""
    left, chosen = int(found["missing"].iloc[0]), []
    for row in found.sort_values(["size", "h"], ascending=[False, True]).itertuples():
        if row.size <= left:
            left -= row.size
            chosen.append(row.h)
    return pd.DataFrame({"part": [key[0]] * len(chosen), "h": chosen}).astype("int64")


def mix(docs: DataFrame, quotas: dict[str | None, int], most_repeats: int = 2, seed: int = 12) -> DataFrame:
    """doc_id, size, sources, repeats, taken (size times repeats): a row for each row of docs (doc_id, size, sources).

    sources is an array of names; null among them is a source of its own, a null or
    empty array or a source without quota gets nothing. A null size is 0 and adds
    nothing. Rows that repeat an id and a size are taken or left together, so are rows
    of one size with null ids. An empty table gives an empty one; other columns are
    ignored. Patterns that take part of a reading come within their smallest documents
    of it; none is read more than most_repeats times. Reruns agree: order is by hash.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"),
        F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>")))).alias("sources"),
    ).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1))
    rows = table(rows.withColumn("pattern", F.to_json("sources")), "mixing-rows")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("n"), F.first("sources").alias("sources")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    found.sort(key=lambda r: r["pattern"])
    flow = route({tuple(r["sources"]): r["n"] for r in found}, quotas, most_repeats)
    plan = []
    for part, r in enumerate(found):
        whole, rest = divmod(flow[tuple(r["sources"])], r["n"]) if r["n"] else (0, 0)
        plan.append((r["pattern"], part, whole, rest, rest / r["n"] if r["n"] else 0.0))
    parts = F.broadcast(spark.createDataFrame(plan, "pattern string, part int, whole long, rest long, portion double"))
    placed = rows.join(parts, "pattern").withColumn("class", F.length(F.bin("size")))
    units = placed.where("rest > 0 and size > 0").select("part", "class", "h", "size", "portion", F.col("rest").alias("wanted"))
    cuts = _cuts(units.drop("wanted"))  # a row for each part and class: MOST_PATTERNS * 64 at most
    cut = units.join(F.broadcast(cuts), ["part", "class"])
    taken = cut.groupBy("part").agg((F.max("wanted") - F.coalesce(F.sum(F.when(F.col("h") < F.col("cut"), F.col("size"))), F.lit(0))).alias("missing"))
    least = cut.where("h >= cut").groupBy("part", "class", F.pmod("h", F.lit(FILLERS)).alias("k")).agg(F.min("h").alias("h")).drop("k")
    fillers = units.join(F.broadcast(least), ["part", "class", "h"]).groupBy("part", "h").agg(F.sum("size").alias("size")).join(F.broadcast(taken), "part")
    chosen = table(fillers.groupBy("part").applyInPandas(_fill, "part int, h long"), "mixing-chosen", True)
    more = placed.join(F.broadcast(cuts), ["part", "class"], "left").join(F.broadcast(chosen.withColumn("chosen", F.lit(True))), ["part", "h"], "left")
    once_more = (F.col("size") > 0) & (F.col("rest") > 0) & (F.coalesce(F.col("h") < F.col("cut"), F.lit(False)) | F.coalesce("chosen", F.lit(False)))
    repeats = F.when(F.col("size") > 0, F.col("whole") + once_more.cast("long")).otherwise(0)
    return more.select("doc_id", "size", "sources", repeats.alias("repeats")).withColumn("taken", F.col("size") * F.col("repeats"))


def mix_by_source(docs: DataFrame, weights: Iterable[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), most_repeats: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken: documents (doc_id, text, source) mixed so that each source nears its target.

    Size: number of `[^\\x20\\x09-\\x0D]+` in the text (null: 0). Sources by code point, null
    last and a source like any other, have the weights in turn; see targets() and mix().
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.col("source").cast("string").alias("source"),
    )
    sized = table(sized, "mixing-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    turns = list(weights)
    aims = targets([r["n"] for r in found], [turns[i % len(turns)] for i in range(len(found))], share, most_repeats)
    mixed = mix(sized.select("doc_id", "size", F.array("source").alias("sources")), {r["source"]: int(t) for r, t in zip(found, aims, strict=True)}, most_repeats)
    facts = [(r["source"], r["n"], float(t)) for r, t in zip(found, aims, strict=True)]
    known = F.broadcast(spark.createDataFrame(facts, "source string, source_size long, target double"))
    return (
        mixed.withColumn("name", F.col("sources")[0]).join(known, F.col("name").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken", "repeats", "source")
    )
