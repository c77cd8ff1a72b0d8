"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document's set is its distinct word shingles (64-bit hashes); its signature has the least hash
under each of `coordinates` functions. Documents of equal sets are collapsed first. The others are
posted under each (coordinate, value); two documents whose similarity reaches the threshold collide
in at least `match` coordinates but for a chance of `miss` (0: one collision will do, so that none
is missed but for a chance of (1 - similarity)^coordinates, below 1e-33). So only the rarest
coordinates - match + 1 postings of a document, in one global order, can be the first that a pair
shares: values posted once are skipped, and the prefix of the rest makes the lists. Documents that
share a list are gathered under the list's least document, in blocks. Within a pair of blocks,
collisions are counted by merging posting lists with skips: a document merges only the shortest
coordinates - match + 1 of its lists, and skips through the others for the candidates found there.
Pairs above `match` are confirmed on their full sets. Only a spanning forest of the links leaves a
task. Rows of long lists and of large groups of equal sets meet their list or group by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, scratch, share_code, spread_join, stored, with_row_key
from .embeddup import forest
from .tokens import batches_of

COORDINATES, BLOCK = 48, 512
_P = np.uint64(0x9E3779B97F4A7C15)


def least_match(similarity: float, coordinates: int = COORDINATES, miss: float = 1e-7) -> int:
    """The collisions that a pair of this similarity has, but for a chance of at most miss."""
    below = 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; words' hashes are remembered within a bound."""

    def __init__(self, words: int = 3, most: int = 1_000_000):
        self.words, self.most, self.known = words, most, {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        known, split = self.known, [x.encode().lower().split() for x in texts]
        if len(known) > self.most:
            known.clear()
        for w in {w for x in split for w in x if w not in known}:
            known[w] = xxhash.xxh64_intdigest(w)
        out = []
        for x in split:
            h = np.fromiter(map(known.__getitem__, x), dtype=np.uint64, count=len(x))
            if not len(h):
                out.append(h)
                continue
            k = min(self.words, len(h))
            s = np.full(len(h) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                s = (s + h[i : len(h) - k + 1 + i]) * _P
                s ^= s >> np.uint64(29)
            out.append(np.unique(_mixed(s)))
        return out


def functions(coordinates: int) -> list[tuple[np.uint64, np.uint64]]:
    """A mask and an odd multiplier for each coordinate."""
    draws = np.random.default_rng(20240229).integers(0, 1 << 63, (coordinates, 2), dtype=np.uint64)
    return [(a * np.uint64(2), b * np.uint64(2) + np.uint64(1)) for a, b in draws]


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of signed 32-bit values for each set; zeros for an empty set."""
    out = np.zeros((len(sets), coordinates), dtype=np.int32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some])[:-1]))
        for k, (mask, a) in enumerate(functions(coordinates)):
            least = np.minimum.reduceat(((flat ^ mask) * a) >> np.uint64(32), starts)
            out[some, k] = least.astype(np.uint32).view(np.int32)
    return out


def collisions(sa: np.ndarray, sb: np.ndarray, match: int) -> np.ndarray:
    """Pairs (i, j) of rows that agree in at least match coordinates.

    Each row of sa has a posting list of rows of sb for each coordinate. A pair with match collisions
    shares one of the row's shortest coordinates - match + 1 lists: those are merged, and the
    candidates found there are looked up in the rest.
    """
    coordinates = sa.shape[1]
    order = np.argsort(sb, axis=0, kind="stable")
    lo, hi = (np.stack([np.searchsorted(sb[order[:, k], k], sa[:, k], side) for k in range(coordinates)], axis=1) for side in ("left", "right"))
    size = hi - lo
    prefix = np.argpartition(size, coordinates - match, axis=1)[:, : coordinates - match + 1] if match > 1 else np.tile(np.arange(coordinates), (len(sa), 1))
    out = []
    for at in range(0, len(sa), 64):
        i, c = np.arange(at, min(at + 64, len(sa)))[:, None], prefix[at : at + 64]
        n, first = size[i, c].ravel(), lo[i, c].ravel()
        owner = np.repeat(np.broadcast_to(i, c.shape).ravel(), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        j = order[place, np.repeat(c.ravel(), n)]
        found = np.unique(owner * len(sb) + j)
        x, y = found // len(sb), found % len(sb)
        same = np.zeros(len(found), dtype=np.int64)
        for k in range(coordinates):
            same += sa[x, k] == sb[y, k]
        out.append(np.stack([x, y], axis=1)[same >= match])
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def _links(a: list[np.ndarray], sa: np.ndarray, b: list[np.ndarray], sb: np.ndarray, alone: bool, match: int, num: int, den: int) -> np.ndarray:
    """Pairs (i, j) with enough collisions and den * |intersection| >= num * |union|."""
    na, nb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    if not len(a) or not len(b):
        return np.zeros((0, 2), dtype=np.int64)
    p = collisions(sa, sb, match)
    x, y = na[p[:, 0]], nb[p[:, 1]]
    p = p[den * np.minimum(x, y) >= num * np.maximum(x, y)]
    if alone:
        p = p[p[:, 0] < p[:, 1]]
    if not len(p):
        return p
    if len(p) < 2000:
        inter = np.empty(len(p), dtype=np.int64)
        for n, (i, j) in enumerate(p.tolist()):
            x, y = (a[i], b[j]) if len(a[i]) >= len(b[j]) else (b[j], a[i])
            inter[n] = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    else:
        ra, rb = np.unique(p[:, 0]), np.unique(p[:, 1])
        sets = [a[i] for i in ra] + [b[j] for j in rb]
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
        keep = df[inverse] > 1
        _, cols = np.unique(inverse[keep], return_inverse=True)
        owner, order = owner[keep], np.argsort(cols, kind="stable")
        owner, cols = owner[order], cols[order]
        dense = np.zeros((len(ra), len(rb)))
        step = 8192
        for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, step):
            at = slice(*np.searchsorted(cols, [lo, lo + step]))
            m = np.zeros((len(sets), step), dtype=np.float32)
            m[owner[at], cols[at] - lo] = 1
            dense += m[: len(ra)] @ m[len(ra) :].T
        inter = dense[np.searchsorted(ra, p[:, 0]), np.searchsorted(rb, p[:, 1])].astype(np.int64)
    union = na[p[:, 0]] + nb[p[:, 1]] - inter
    return p[den * inter >= num * union]


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: tuple[int, int] = (80, 100), coordinates: int = COORDINATES, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each input row.

    Linked are documents of equal sets, or with similarity[1] * |intersection| >= similarity[0] *
    |union| (ties count). Null texts count as empty; empty sets and null ids link with nothing. With
    fewer words than a shingle the whole sequence is the one shingle. component_id is the least id
    reachable. Ids are meant to be unique: rows that repeat one are compared each by its own text,
    as one node. Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    share_code(spark)
    path = scratch(spark)
    match = least_match(similarity[0] / similarity[1], coordinates, miss)
    prefix = coordinates - match + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in batches_of(b.column(1)):
                sets = shingler.sets(texts[lo:hi])
                sig = signatures(sets, coordinates)
                offsets = pa.array(np.arange(0, len(sets) * coordinates + 1, coordinates, dtype=np.int32))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))],
                    names=["doc_id", "n", "digest", "sig"],
                )

    signs = stored(rows.mapInArrow(signed, "doc_id long, n long, digest binary, sig array<int>"), f"{path}/signatures")
    some = signs.where("n > 0 and doc_id is not null")
    # The least document of each set stands for all of them.
    reps = some.groupBy("digest").agg(F.min(F.struct("doc_id", "sig")).alias("r"), F.count("*").alias("copies"))
    reps = stored(reps.select("digest", F.col("r.doc_id").alias("rep"), F.col("r.sig").alias("sig"), "copies"), f"{path}/classes")
    classes = reps.select("digest", "rep", "copies")
    posted = reps.select(F.col("rep").alias("doc_id"), F.posexplode("sig").alias("k", "v"))
    lists = stored(posted.groupBy("k", "v").agg(F.count("*").alias("m")).where("m > 1"), f"{path}/lists")
    shared = spread_join(posted, lists, ["k", "v"], "m")
    mine = Window.partitionBy("doc_id")
    # Of a document's postings, those that occur once come first in the order and are skipped.
    order = F.row_number().over(mine.orderBy("m", "k", "v"))
    shared = shared.select("doc_id", "k", "v", order.alias("r"), F.count("*").over(mine).alias("c")).where(F.col("r") + F.greatest(F.lit(0), F.lit(coordinates) - F.col("c")) <= prefix)
    shared = stored(shared.select("doc_id", "k", "v"), f"{path}/postings")
    heads = stored(shared.groupBy("k", "v").agg(F.min("doc_id").alias("head"), F.count("*").alias("m")).where("m > 1"), f"{path}/heads")
    members = stored(spread_join(shared, heads, ["k", "v"], "m").select("head", "doc_id").distinct(), f"{path}/members")
    blocks = stored(members.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m")), f"{path}/blocks")
    nodes = members.select("doc_id").distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in batches_of(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in shingler.sets(texts[lo:hi])], pa.binary())], names=["doc_id", "s"])

    # The nodes grow with the corpus: the plan must not depend on whether they still fit a broadcast.
    sets = rows.join(nodes.hint("merge"), "doc_id", "left_semi").mapInArrow(shingled, "doc_id long, s binary")
    dealt = spread_join(members, blocks, ["head"], "m")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("head", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "doc_id").join(sets.hint("merge"), "doc_id")

    def linked(df: pd.DataFrame) -> pd.DataFrame:
        ids, block, a, b = df["doc_id"].to_numpy(), df["block"].to_numpy(), df["a"].iloc[0], df["b"].iloc[0]
        every = [np.frombuffer(x, dtype=np.uint64) for x in df["s"]]
        sig = signatures(every, coordinates)
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        found = _links([every[i] for i in left], sig[left], [every[i] for i in right], sig[right], a == b, match, *similarity)
        pairs = np.stack([left[found[:, 0]], right[found[:, 1]]], axis=1).tolist() if len(found) else []
        top = np.array(forest(len(df), pairs), dtype=np.int64)
        own = top != np.arange(len(df))
        return pd.DataFrame({"a": ids[own], "b": ids[top[own]]})

    edges = dealt.groupBy("head", "a", "b").applyInPandas(linked, "a long, b long")
    joined = components(edges)
    verdicts = classes.join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("root"), "copies")
    narrow = signs.select("doc_id", "n", "digest")
    found = spread_join(narrow.where("n > 0 and doc_id is not null"), stored(verdicts, f"{path}/verdicts"), ["digest"], "copies")
    out = found.select("doc_id", "n", "root").unionByName(narrow.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("root")))
    component = F.col("root")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs with one row of each component: the one of least id, nulls last, then of least row hash.

    Rows are nodes by all their columns, not by their ids, so no text is lost to a null or repeated
    id; rows that agree in every column count once. Texts without words link with nothing and stay.
    Long texts are read whole. Other columns are carried, whatever their names. An empty table gives
    an empty one.
    """
    rows, keys = with_row_key(docs)
    path = scratch(docs.sparkSession)
    found = near_duplicates(rows, keys[0], text_col, **options).select(F.col("doc_id").alias("node"), F.col("component_id").alias("root"))
    ids = rows.select(F.col(keys[0]).alias("node"), F.col(keys[1]).alias("too"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id")).distinct()
    best = ids.join(found.distinct().hint("merge"), "node").groupBy("root").agg(F.min(F.struct("id", "node", "too")).alias("b"))
    best = stored(best.select(F.col("b.node").alias(keys[0]), F.col("b.too").alias(keys[1])), f"{path}/kept")
    return rows.dropDuplicates(keys).join(best.hint("merge"), keys, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
