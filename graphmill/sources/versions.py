"""Tables in versions: a writer never touches what a reader has open.

A version is a folder of Parquet tables with a name of its own; a pointer, a small file
with a rising number, makes it current. Pointers are made once and never overwritten: of
two writers one gets the number, the other the next. A reader takes the newest pointer
that is whole, and its tables stay as they are until they are expired.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

POINTERS = "pointers"


@dataclass(frozen=True)
class Version:
    """What a pointer says: its number, what it is of, when it was made, and the folders of each table."""

    number: int
    stamp: Mapping[str, Any]
    made: float
    tables: Mapping[str, list[str]]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(*self.tables[name])


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, root: str) -> Iterator[Version]:
    """The newest first; one that is not whole, as of a writer that died, is passed over."""
    folder, fs = _path(spark, f"{root}/{POINTERS}")
    if not fs.exists(folder):
        return
    for name in sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True):
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            yield Version(int(name.split(".")[0]), said["stamp"], said["made"], said["tables"])
        except (ValueError, KeyError, TypeError):
            continue
        finally:
            stream.close()


def current(spark: SparkSession, root: str) -> Version | None:
    return next(_pointers(spark, root), None)


def point(spark: SparkSession, root: str, stamp: Mapping[str, Any], tables: Mapping[str, list[str]], after: int | None = None, made: float | None = None) -> Version | None:
    """A new pointer; with after only if that is still the newest number (0: none yet), else None."""
    made = time.time() if made is None else made
    while True:
        newest = current(spark, root)
        number = (newest.number if newest else 0) + 1
        if after is not None and number != after + 1:
            return None
        at, fs = _path(spark, f"{root}/{POINTERS}/{number:020d}.json")
        try:
            out = fs.create(at, False)  # fails if another writer has it
        except Exception as error:  # noqa: BLE001  py4j wraps what the file system throws
            if not fs.exists(at):
                raise
            if current(spark, root) == newest:  # a pointer that was never finished keeps its number
                time.sleep(0.2)
                if current(spark, root) == newest:
                    fs.delete(at, False)
            if after is not None:
                return None
            del error
            continue
        try:
            out.write(bytearray(json.dumps({"stamp": dict(stamp), "made": made, "tables": {k: list(v) for k, v in tables.items()}}), "utf-8"))
        finally:
            out.close()
        return Version(number, dict(stamp), made, tables)


def write(df: DataFrame, root: str, name: str) -> str:
    """df in a folder that no pointer names yet."""
    path = f"{root}/data/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def publish(tables: Mapping[str, DataFrame], root: str, stamp: Mapping[str, Any], made: float | None = None) -> Version:
    """All tables written, then made current together."""
    spark = next(iter(tables.values())).sparkSession
    done = point(spark, root, stamp, {name: [write(df, root, name)] for name, df in tables.items()}, made=made)
    assert done is not None
    return done


def matching(spark: SparkSession, root: str, head: str, files: int, tier: int = 0) -> Version | None:
    """The newest version of a commit with so many files whose tier is at least the one wanted."""
    return next((v for v in _pointers(spark, root) if v.stamp.get("head") == head and v.stamp.get("files") == files and v.stamp.get("tier", 0) >= tier), None)


def serve(spark: SparkSession, root: str, head: str, files: int, tier: int, compute: Callable[[], Mapping[str, DataFrame]], max_age: float | None = None) -> tuple[Version, Callable[[], Version] | None]:
    """(version, revalidate): what is there at once, and what is to be called for a newer one, None if it is fresh.

    Fresh is a version of this head, number of files and tier that is not older than
    max_age seconds. Any other version of the tier is served stale; where there is none, it
    is computed now.
    """
    renew = lambda: publish(compute(), root, {"head": head, "files": files, "tier": tier})
    fresh = matching(spark, root, head, files, tier)
    if fresh is not None and (max_age is None or time.time() - fresh.made <= max_age):
        return fresh, None
    stale = fresh or next((v for v in _pointers(spark, root) if v.stamp.get("tier", 0) >= tier), None)
    return (stale, renew) if stale is not None else (renew(), None)


def expire(spark: SparkSession, root: str, keep: int = 2, older_than: float = 3600.0) -> int:
    """Pointers but the newest ones go, and folders that no pointer names and no writer may still be filling; how many folders went."""
    every = list(_pointers(spark, root))
    limit = time.time() - older_than
    gone = [v for v in every[keep:] if v.made < limit]
    for v in gone:
        at, fs = _path(spark, f"{root}/{POINTERS}/{v.number:020d}.json")
        fs.delete(at, False)
    named = {p.rsplit("/", 1)[-1] for v in every if v not in gone for paths in v.tables.values() for p in paths}
    folder, fs = _path(spark, f"{root}/data")
    n = 0
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        if status.getPath().getName() not in named and status.getModificationTime() / 1000 < limit:
            n += bool(fs.delete(status.getPath(), True))
    return n


def fold(batch: DataFrame, root: str, table: str, combine: Callable[[DataFrame], DataFrame], epoch: int, most_parts: int = 8) -> bool:
    """One epoch of a stream into a table by key; False if it is in already.

    combine turns rows into one for each key and may be applied again to its own results.
    The epoch's rows become a part of their own, and past most_parts the parts become one.
    The pointer names the last epoch that the parts hold, so an epoch that is replayed,
    after a crash before or after its pointer, counts once.
    """
    spark = batch.sparkSession
    while True:
        old = current(spark, root)
        if old is not None and old.stamp["epoch"] >= epoch:
            return False
        parts = list(old.tables[table]) if old else []
        fresh = combine(batch)
        if len(parts) >= most_parts:
            fresh, parts = combine(spark.read.schema(fresh.schema).parquet(*parts).unionByName(fresh)), []
        path = write(fresh, root, table)
        if point(spark, root, {"epoch": epoch}, {table: [*parts, path]}, after=old.number if old else 0) is not None:
            return True


def folded(spark: SparkSession, root: str, table: str, combine: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The table by key as of its last epoch; None before the first."""
    version = current(spark, root)
    return None if version is None else combine(version.read(spark, table))


def memoized(rows: DataFrame, root: str, key: str, compute: Callable[[DataFrame], DataFrame], name: str = "memo", most_parts: int = 8) -> tuple[DataFrame, int]:
    """(rows with what compute gives for their key, how many keys were computed): keys that were computed before are looked up.

    key is a column with a digest of all that compute reads; compute takes distinct rows by
    key and gives key and further columns. Rows with a null key get nulls. Two writers at
    once may compute a key twice, and both are kept as one.
    """
    spark = rows.sparkSession
    while True:
        old = current(spark, root)
        known = None if old is None else old.read(spark, name).dropDuplicates([key])
        wanted = rows.where(rows[key].isNotNull()).dropDuplicates([key])
        unseen = wanted if known is None else wanted.join(known.select(key), key, "left_anti")
        path = write(compute(unseen), root, name)
        added = spark.read.parquet(path)
        n = added.count()
        parts = list(old.tables[name]) if old else []
        if n == 0 and old is not None:
            every = known
            break
        if len(parts) >= most_parts:
            path, parts = write(spark.read.parquet(*parts, path).dropDuplicates([key]), root, name), []
        if point(spark, root, {"keys": n}, {name: [*parts, path]}, after=old.number if old else 0) is not None:
            every = added if known is None else known.unionByName(added)
            break
    return rows.join(every, key, "left"), n
