"""Helpers shared by the training-data operators: scratch tables, hashing of words, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and normalisation rule here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches of all operators here: rows are whole texts.
ROWS_A_BATCH, BYTES_A_BATCH = 1000, 2 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only on one machine (a local master) may that setting be missing: a temporary folder takes its
    place there. Tables in it feed lazily evaluated results, so they stay until clean() is called.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "lakelens-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{_own(spark, base)}/{uuid.uuid4().hex}"


def _own(spark: SparkSession, base: str) -> str:
    return f"{base.rstrip('/')}/lakelens-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes what this application's operators have stored; results not yet written are lost."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark, base))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as a Parquet table and read again: cuts lineage, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_code(spark: SparkSession) -> None:
    """Readies a session for Python workers, in the same way for every operator.

    Arrow batches are held to ROWS_A_BATCH rows and about BYTES_A_BATCH bytes, as rows are whole
    texts. Workers on this host import the package from the driver's path; on other hosts it must be
    installed or shipped (--py-files).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BYTES_A_BATCH}b")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with two 64-bit hashes of all columns of a row, and their names: rows that agree in everything share them."""
    plain = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        plain += [F.isnull(c), F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c]
    names = [free_name(df, "__row"), free_name(df, "__row_too")]
    return df.withColumns({n: F.xxhash64(F.lit(i), *plain) for i, n in enumerate(names)}), names


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], n: str, share: int = 1000, total: int | None = None) -> DataFrame:
    """rows joined with a table of their keys, whose column n says how many rows a key has.

    Keys with more than one in `share` of all rows are fewer than `share`, whatever the data: those
    are broadcast, so no task gets all rows of a hot key. The rest meets in a shuffle. Both tables
    are read twice and should be stored ones; rows without a match or with a null key are left out.
    total, the sum of n or more, is taken from side where it isn't given.
    """
    if total is None:
        total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot, cold = side.where(F.col(n) > total / share), side.where(F.col(n) <= total / share)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys))


def release() -> None:
    """Gives a Python worker's free memory back to the system; idle workers stay alive for a while."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def crc32_of_id(doc_id) -> F.Column:
    """crc32 of the id as text; the id -1 stands for a missing one."""
    return F.crc32(F.coalesce(doc_id, F.lit(-1)).cast("string").cast("binary"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder. Rows of a hub
    learn its least neighbour by broadcast, and are never gathered. Loops and nulls are ignored;
    nodes without an edge don't appear; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    base = scratch(spark)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    now = stored(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        f"{base}/0",
    )
    before = mark(now)
    for k in range(1, most_rounds + 1):
        if not before[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.where("v > u"), least, ["u"], "n", total=2 * before[0]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        top = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, top, ["hi"], "n", total=2 * before[0]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = stored(small.unionByName(top.select("hi", F.col("m").alias("lo"))).distinct(), f"{base}/{k}")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
