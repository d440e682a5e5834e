"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, decimals: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same in every engine, unlike round() on ties."""
    scale = float(10**decimals)
    return F.floor(value * scale + F.lit(0.5)) / scale


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last `/`; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows, as stored; empty for none and for dot files."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def fold_dots(path: Column) -> Column:
    """`a/./b/../c` as `a/c`; leading `..` stay."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(folded, "/")


def package_name(target: Column) -> Column:
    """The package of an import target: without node_modules, with its scope."""
    bare = F.regexp_replace(target, r"^.*node_modules/", "")
    return F.when(bare.startswith("@"), F.substring_index(bare, "/", 2)).otherwise(F.substring_index(bare, "/", 1))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def token_estimate(text: Column, up: bool = True) -> Column:
    """Characters by four, rounded up, or half up."""
    quarter = F.char_length(text) / 4
    return (F.ceil(quarter) if up else F.floor(quarter + 0.5)).cast("long")
