"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

Documents are cut into pieces of at most the capacity. Pieces are dealt by hash into shards of about
`per_shard`, each packed in one task: pieces in descending size go to the bin of least residual that
holds them and doesn't conflict. Open bins are kept in the order of their residuals, each with a
bitmap of the sources and duplicate clusters that it holds; from the first bin with room, the search
goes on to the successor until one is compatible, and else opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, scratch, share_code, stored

_OUT = "doc_id long, copy int, piece int, length long, bin_id long, start long"


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each (size, bitmap), sizes in descending order and at most the capacity."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    maps: list[int] = []
    out = []
    for size, bits in items:
        i = bisect_left(order, (size, -1))
        while i < len(order) and maps[order[i][1]] & bits:
            i += 1
        residual, b = order.pop(i) if i < len(order) else (capacity, len(maps))
        if b == len(maps):
            maps.append(0)
        out.append((b, capacity - residual))
        maps[b] |= bits
        if residual > size:
            insort(order, (residual - size, b))
    return out


def pack(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", cluster_col=None, capacity: int = 2048, per_shard: int = 2048, one_per_source: bool = True) -> DataFrame:
    """doc_id, copy, piece, length, bin_id, start: one row for each piece of each input row.

    Lengths are words. A bin holds at most one piece of a duplicate cluster and, with
    one_per_source, of a source; null sources conflict with nothing. Clusters are cluster_col's
    values (null: none) or, without it, texts equal but for white space. Pieces of one document
    conflict, too. Texts without words have one piece of length 0 and no bin. Repeated rows get
    copy numbers 1, 2, ... and conflict. Ties go by id, copy and piece, so reruns agree. Null ids are
    carried. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    share_code(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cluster = F.xxhash64(F.regexp_replace(text, SPACE + "+", "")) if cluster_col is None else F.xxhash64(F.col(cluster_col).cast("string"))
    if cluster_col is not None:
        cluster = F.when(F.col(cluster_col).isNotNull(), cluster)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n"), cluster.alias("cluster")
    )
    # Repeated rows are counted before they are dealt out, so that many of them spread like others.
    rows = rows.groupBy("doc_id", "source", "n", "cluster").agg(F.count("*").cast("int").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(1), last)))
    rows = rows.withColumn("length", F.least(F.lit(capacity), F.col("n") - (F.col("piece") - 1) * capacity).cast("long"))
    rows = stored(rows.drop("n"), scratch(spark) + "/pieces")
    shards = max(1, -(-rows.where("length > 0").count() // per_shard))

    def packed(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "copy", "piece", "cluster", "source"], ascending=[False, True, True, True, True, True], kind="stable", na_position="last")
        own = [("id", d) if d == d and d is not None else ("row", i) for i, d in enumerate(df["doc_id"])]
        marks = []
        for s, c, d in zip(df["source"], df["cluster"], own, strict=True):
            marks.append(([("s", s)] if one_per_source and isinstance(s, str) else []) + ([("c", int(c))] if not pd.isna(c) else []) + [d])
        seen = Counter(m for x in marks for m in x)
        bit: dict = {}
        for m, n in seen.items():  # a mark that comes once can't conflict
            if n > 1:
                bit[m] = 1 << len(bit)
        sizes = df["length"].tolist()
        places = best_fit([(n, sum(bit.get(m, 0) for m in set(x))) for n, x in zip(sizes, marks, strict=True)], capacity)
        first = int(df["shard"].iloc[0]) << 24
        return pd.DataFrame({
            "doc_id": df["doc_id"], "copy": df["copy"], "piece": df["piece"], "length": df["length"],
            "bin_id": [first + b for b, _ in places], "start": [a for _, a in places],
        })

    shard = F.pmod(F.xxhash64("doc_id", "copy", "piece", "cluster"), F.lit(shards)).cast("long")
    out = rows.where("length > 0").withColumn("shard", shard).groupBy("shard").applyInPandas(packed, _OUT)
    none = rows.where("length <= 0").select("doc_id", "copy", "piece", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("start"))
    return out.unionByName(none)
