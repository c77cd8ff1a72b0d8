"""Exact deduplication by skew-safe combining, on DataFrame operations only.

Texts are equal when identical after deleting white space (space, U+0009 to U+000D). Copies meet in
three steps: within each task (the map side of the first aggregation), within salted digest groups,
and then across the salts. The grouping key of both aggregations is the digest and the whole
normalised text, so full contents are compared at every step; a digest never decides alone. Each
row then learns its group's verdict by a join in which the digests of large groups are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, scratch, spread_join, stored, with_row_key

_SHIFT = "18446744073709551616"  # 2^64
_TOP = "9223372036854775807"  # 2^63 - 1


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the columns named in carried; one row for each input row.

    Of a group, the row with the most code points stays, then the smallest id. Null texts count as
    empty; all empty texts are one group. A null id comes after every other id; if only such rows
    are in a group, keep_id is null and they are kept. Repeated rows of the winning id are all
    marked kept and count in group_size. Long texts are grouped whole. No rows give no rows; other
    columns are not read.
    """
    path = scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"), *[F.col(f"`{c}`") for c in carried])
    base = base.select("__id", F.length("__text").alias("__len"), F.regexp_replace("__text", SPACE + "+", "").alias("__norm"), *[F.col(f"`{c}`") for c in carried])
    sha = F.sha2(F.col("__norm").cast("binary"), 256)
    order = F.col("__len").cast("decimal(38,0)") * F.expr(f"cast('{_SHIFT}' as decimal(20,0))") + (
        F.expr(f"cast('{_TOP}' as decimal(20,0))") - F.coalesce("__id", F.expr(f"{_TOP}L")).cast("decimal(20,0)")
    )
    rows = base.select(
        F.unhex(sha).alias("__sha"), "__norm", F.pmod(F.xxhash64("__id", "__len"), F.lit(salts)).cast("int").alias("__salt"), order.cast("decimal(38,0)").alias("__rank")
    )
    salted = rows.groupBy("__salt", "__sha", "__norm").agg(F.max("__rank").alias("__rank"), F.count("*").alias("__n"))
    merged = salted.groupBy("__sha", "__norm").agg(F.max("__rank").alias("__rank"), F.sum("__n").alias("__n"))
    # From here on a content goes by its digest, a second hash and its length; two contents that
    # agree in all three would stop the job rather than be mixed up.
    small = merged.select("__sha", F.xxhash64("__norm").alias("__hash"), F.length("__norm").alias("__size"), "__rank", "__n")
    winners = small.groupBy("__sha", "__hash", "__size").agg(F.max("__rank").alias("__rank"), F.sum("__n").alias("__n"), F.count("*").alias("__contents"))
    shift = F.expr(f"cast('{_SHIFT}' as decimal(20,0))")
    last = F.col("__rank") % shift
    winners = winners.select(
        "__sha", "__hash", "__size",
        F.when(F.col("__contents") == 1, F.col("__n")).otherwise(F.raise_error(F.lit("two contents share every digest")).cast("long")).alias("group_size"),
        F.when(last > 0, (F.expr(f"cast('{_TOP}' as decimal(20,0))") - last).cast("long")).alias("keep_id"),
    )
    winners = stored(winners, f"{path}/winners")
    each = base.select("__id", F.unhex(sha).alias("__sha"), F.xxhash64("__norm").alias("__hash"), F.length("__norm").alias("__size"), *[F.col(f"`{c}`") for c in carried])
    each = spread_join(stored(each, f"{path}/digests"), winners, ["__sha", "__hash", "__size"], "group_size")
    return each.select(
        F.col("__id").alias("doc_id"), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"),
        *[F.col(f"`{c}`") for c in carried],
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: the one that duplicate_groups keeps.

    Of several rows that it marks kept (repeated ids), the longest stays, then the one of least row
    hash. Rows are told apart by all their columns, not by their ids, so every text stays in one
    row, whatever ids are null or repeated. Null and empty texts are one group. Other columns are
    carried, whatever their names. An empty table gives an empty one.
    """
    rows, keys = with_row_key(docs)
    size = F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = duplicate_groups(rows.withColumn("__points", size), id_col, text_col, carried=(*keys, "__points")).where("kept")
    best = found.groupBy("text_sha256").agg(F.min(F.struct(-F.col("__points"), *keys)).alias("b")).select(*[F.col(f"b.{k}").alias(k) for k in keys])
    return rows.dropDuplicates(keys).join(best.hint("merge"), keys, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
