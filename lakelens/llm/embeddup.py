"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Identical vectors of a label are collapsed first. The rest of a label is dealt into tiles; each pair
of tiles is one task's work. A unit vector x is s q + e with q in int8 and |e| known, so
|x.y - s s' q.q'| <= |s q| |e'| + |e| |s' q'| + |e| |e'|. Products of the q are exact in float32 (the
int8 sums stay below 2^24 by cutting the dimensions into runs). Only pairs whose product plus bound
reaches the threshold are computed again in double precision. Tiles give link counts and a spanning
forest of their links, never the links themselves. Rows of a vector that very many share learn its
verdict by broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, scratch, share_code, spread_join, stored

TILE = 2048
RUN = 1024  # 1024 * 127^2 < 2^24


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q, s, |s q| and |e| of unit rows x, the norms rounded up."""
    s = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    near = q * s[:, None]
    slack = 1 + 1e-9
    return q, s, np.sqrt((near * near).sum(axis=1)) * slack, np.sqrt(((x - near) ** 2).sum(axis=1)) * slack + 1e-12


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may reach the threshold."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    product = np.zeros((len(sa), len(sb)))
    for lo in range(0, qa.shape[1], RUN):
        product += qa[:, lo : lo + RUN].astype(np.float32) @ qb[:, lo : lo + RUN].astype(np.float32).T
    product *= sa[:, None] * sb[None, :]
    product += na[:, None] * eb[None, :] + ea[:, None] * (nb + eb)[None, :]
    return np.nonzero(product >= threshold - 1e-9)


def forest(n: int, pairs) -> list[int]:
    """The least index of each index's component."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col="vec_id", vector_col="embedding", label_col="label", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each input row.

    Vectors are compared when labels are equal and not null and dimensions agree. Null, empty or
    zero vectors, those with null or non-finite components and rows without an id link with
    nothing and are their own component. Rows that repeat an id are one node of the graph, with the
    links of all their vectors. All pairs at the threshold count, ties included. Other columns are
    not read, and an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    share_code(spark)
    path = scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).cast("string").alias("label"))
    fit = F.expr("coalesce(size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0), false)")
    rows = rows.withColumn("ok", fit & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("hash", F.xxhash64("label", "x"))
    good = rows.where("ok").select("vec_id", "x", "label", "hash")
    copies = good.groupBy("label", "hash", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    copies = stored(copies, f"{path}/copies")
    counts = copies.groupBy("label", F.size("x").alias("d")).agg(F.count("*").alias("m")).withColumn("tiles", F.ceil(F.col("m") / tile).cast("int"))
    dealt = copies.withColumn("d", F.size("x")).join(counts, ["label", "d"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "d", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "rep", "n", "x")

    def tiles(df: pd.DataFrame) -> pd.DataFrame:
        x = np.array(df["x"].tolist(), dtype=np.float64)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by powers of two, so exactly
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        rep, n, side = df["rep"].to_numpy(), df["n"].to_numpy(), df["tile"].to_numpy()
        alone = df["a"].iloc[0] == df["b"].iloc[0]
        left = np.arange(len(df)) if alone else np.flatnonzero(side == df["a"].iloc[0])
        right = np.arange(len(df)) if alone else np.flatnonzero(side == df["b"].iloc[0])
        part = lambda at: tuple(v[at] for v in q)
        q, links, pairs = quantised(unit), np.zeros(len(df), dtype=np.int64), []
        for lo in range(0, len(left), 512):
            i, j = possible(part(left[lo : lo + 512]), part(right), threshold)
            i, j = left[lo : lo + 512][i], right[j]
            if alone:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 1 << 16):
                p, r = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                hit = np.einsum("ij,ij->i", x[p], x[r]) / np.sqrt((x[p] ** 2).sum(axis=1) * (x[r] ** 2).sum(axis=1)) >= threshold
                p, r = p[hit], r[hit]
                np.add.at(links, p, n[r])
                np.add.at(links, r, n[p])
                pairs.append(np.stack([p, r], axis=1))
        flat = np.concatenate(pairs).tolist() if pairs else []
        top = np.array(forest(len(df), flat), dtype=np.int64)
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some], "to": rep[top[some]]})

    found = stored(dealt.groupBy("label", "d", "a", "b").applyInPandas(tiles, "rep long, links long, to long"), f"{path}/links")
    ids = spread_join(good, copies, ["label", "hash", "x"], "n").select("vec_id", "rep", "n")
    joined = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    out = ids.join(sums, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
