"""What operators need of the cluster: code on the executors, a shared folder, tables that cut lineage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast; callers need another way beyond it.
BROADCAST_ROWS = 200_000
#: Bytes up to which Spark may broadcast a table that wasn't counted, in what cut() writes.
UNCOUNTED = 256 << 10


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_scholium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    d = tempfile.mkdtemp(prefix="scholium-src-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, d, True)
    path = os.path.join(d, "scholium-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._scholium_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = Path(tempfile.mkdtemp(prefix="scholium-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that cut() makes inside are deleted at the end, but for those that keep() has taken out: for work whose result is written before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Takes a table that cut() made out of the scratch tables."""
    path = getattr(df, "_scholium_path", None)
    for tables in _scratch:
        if path in tables:
            tables.remove(path)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scholium-{name}-{uuid.uuid4().hex}"


@contextmanager
def counted_broadcasts(spark: SparkSession):
    """Inside, Spark broadcasts of its own accord only what is under UNCOUNTED bytes: by its default, tables of 10 MB, compressed, go through the driver, which are millions of narrow rows."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for n, b in zip(names, before):
            spark.conf.set(n, str(UNCOUNTED if b is None else min(UNCOUNTED, size(b))))
        yield
    finally:
        for n, b in zip(names, before):
            spark.conf.unset(n) if b is None else spark.conf.set(n, b)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with counted_broadcasts(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scholium_path = path
    if _scratch:
        _scratch[-1].append(path)
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by cut(); only when nothing reads it any more."""
    path = getattr(df, "_scholium_path", None)
    if path:
        _delete(df.sparkSession, path)


def free(spark: SparkSession) -> None:
    """Collects the driver's garbage, in Python first, whose DataFrames hold plans in the JVM. Its heap shrinks to what is in use; shuffles and broadcasts that only garbage held are cleaned."""
    gc.collect()
    spark._jvm.System.gc()


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", bound: int = BROADCAST_ROWS, salts: int = 32, rows: int | None = None) -> DataFrame:
    """Joins on keys that may be hot in `big`. `small` has one row a key: counted and broadcast up to `bound` rows, else repeated `salts` times and joined on salted keys."""
    rows = small.limit(bound + 1).count() if rows is None else rows
    if rows <= bound:
        return big.join(F.broadcast(small), keys, how)
    salt = (F.monotonically_increasing_id() % salts).cast("int")
    many = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", salt).join(many.hint("merge"), [*keys, "__salt"], how).drop("__salt")  # else Spark may still broadcast it


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, root) with root the smallest node that edges reach, for each node in an edge.

    Alternating large-star and small-star steps; each halves the longest path, and each result is a written table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = cut(e, "cc")
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        nxt = cut(small, "cc")
        sums = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(sums):
            drop(nxt)
            break
        seen = tuple(sums)
        drop(now)
        now = nxt
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
