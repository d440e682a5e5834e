"""URL filtering by rules and by a tree of path templates.

Each host has a tree of path segments. Numbers, dates and hexadecimal ids become
wildcards by their form; level by level, to the deepest path, a node keeps the children
whose labels differ from its own by more than chance explains, and gets one wildcard
child for the rest. The test is the same for nodes of any width: of the children kept,
surest first, chance leaves at most a fifth unexplained on either side (Benjamini and
Hochberg, over Chernoff's bound of each). A template is rejected if the smoothed share of good
labels below it is under the threshold. Rules of host and path come before.

The tree is made of aggregated templates, never of rows: a host with a third of
all pages costs partial aggregates and a join that Spark can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule `example.net/en/` fits that host and its subdomains, and paths that begin with `/en/`.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int | None) -> Column:
    """The segments with variable forms as wildcards; with a depth, what lies deeper is `**`."""
    form = lambda s: (
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "{date}")
        .when(s.rlike(r"^[0-9]+$"), "{n}")
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,8}$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}")
        .otherwise(s)
    )
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), form)
    if depth is None:
        return parts
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def surprise(good: Column, labelled: Column, rate: Column) -> Column:
    """Chernoff's bound on the chance of so many good labels, or of so few, at a rate: minus its logarithm."""
    share = good / labelled
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    return F.when(labelled > 0, labelled * (part(share, rate) + part(1 - share, 1 - rate))).otherwise(0.0)


#: Levels of surprise to a natural logarithm, and the last that is told apart.
STEPS, LAST = 4, 400
#: A child weighs so many labels at most in its node's rate: one large branch doesn't make all others odd.
MOST_WEIGHT = 16


def templates(counts: DataFrame, by_chance: float) -> DataFrame:
    """host, form, template, labelled, good for counts (host, form array, labelled, good), one row per host and form."""
    tree, level = counts.withColumn("template", F.col("form")), 0
    done: list[DataFrame] = []
    while level < (tree.agg(F.max(F.size("form"))).first()[0] or 0):
        level += 1
        node = ["host", "before", "segment"]
        seen = tree.withColumn("before", F.slice("template", 1, level - 1)).withColumn("segment", F.get("template", F.lit(level - 1)))
        children = seen.where("segment is not null").groupBy(*node).agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        weight = F.least(F.col("labelled"), F.lit(MOST_WEIGHT))
        parents = children.groupBy("host", "before").agg(
            F.count(F.lit(1)).alias("children"), F.count_if(F.col("labelled") > 0).alias("judged"), F.sum(weight).alias("weight"), F.sum(F.when(F.col("labelled") > 0, weight * F.col("good") / F.col("labelled"))).alias("of_good")
        )
        rate = (F.coalesce("of_good", F.lit(0.0)) + 1) / (F.col("weight") + 2)
        sure = F.least(F.floor(STEPS * surprise(F.col("good"), F.col("labelled"), rate)), F.lit(LAST))
        judged = table(children.join(parents, ["host", "before"]).select(*node, "children", "judged", sure.alias("sure")), f"urls-children{level}")
        # at most LAST rows of a node are ordered, however many children it has
        sums = judged.groupBy("host", "before", "sure").agg(F.count(F.lit(1)).alias("n"), F.max("judged").alias("judged"))
        surer = sums.withColumn("surer", F.sum("n").over(Window.partitionBy("host", "before").orderBy(F.desc("sure"))))
        cuts = surer.where(F.col("judged") * F.exp(-F.col("sure") / STEPS) <= by_chance * F.col("surer")).groupBy("host", "before").agg(F.min("sure").alias("cut"))
        kept = (F.col("children") == 1) | F.coalesce(F.col("sure") >= F.col("cut"), F.lit(False))
        renamed = judged.join(cuts, ["host", "before"], "left").select(*node, F.when(kept, F.col("segment")).otherwise("*").alias("renamed"))
        moved = seen.join(renamed, node, "left")
        changed = F.concat(F.col("before"), F.array("renamed"), F.slice("template", level + 1, 1 << 30))
        moved = moved.select("host", "form", "labelled", "good", F.when(F.col("renamed").isNull(), F.col("template")).otherwise(changed).alias("template"))
        moved = table(moved.withColumn("prefix", F.slice("template", 1, level)), f"urls-level{level}")
        # below a node with one form nothing is merged any more
        shared = moved.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "prefix")
        done.append(moved.join(shared, ["host", "prefix"], "left_anti").drop("prefix"))
        tree = moved.join(shared, ["host", "prefix"], "left_semi").drop("prefix")
    for part in done:
        tree = tree.unionByName(part)
    return table(tree, "urls-tree")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labelled: DataFrame,
    depth: int | None = None,
    by_chance: float = 0.2,
    strength: float = 4.0,
    threshold: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per row of pages (page_id, url).

    labelled: url, label (1 good, 0 bad; null labels don't count). purity is
    (good + strength * overall rate) / (labelled + strength) of the page's
    template; where no rule fits, the verdict is block if it is below the
    threshold. Without any labels the overall rate is 1. A null url and one
    without `://` have an empty host and path and share one template. A level at
    which several forms still share their beginning costs one round; depth limits them. Repeated
    rows stay, null ids too; other columns are ignored.
    """
    split = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("form", segments(F.col("path"), depth))
    parsed = split(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    known = split(labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("long").alias("label")).where("label is not null"))
    zero = F.lit(0).cast("long")
    forms = (
        parsed.select("host", "form", zero.alias("labelled"), zero.alias("good"))
        .unionByName(known.select("host", "form", F.lit(1).cast("long").alias("labelled"), "label").withColumnRenamed("label", "good"))
        .groupBy("host", "form")
        .agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    )
    tree = templates(table(forms, "urls-forms"), by_chance)
    whole = tree.agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good")).first()
    rate = whole["good"] / whole["labelled"] if whole["labelled"] else 1.0
    leaves = tree.groupBy("host", "template").agg(((F.sum("good") + strength * rate) / (F.sum("labelled") + strength)).alias("purity"))
    verdicts = tree.select("host", "form", "template").join(leaves, ["host", "template"])
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("purity") < threshold, "block").otherwise("allow")
    return parsed.join(verdicts, ["host", "form"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, learned).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"
    )
