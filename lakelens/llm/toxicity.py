"""Toxicity scores of a factorization machine over hashed terms.

score = 1 / (1 + exp(-(w0 + sum w_i + sum over pairs <v_i, v_j>))) over the hashed terms of a text:
pairs of terms, such as an insult with a group's name, count beyond what each term adds. Terms are
words stripped of punctuation, lower-cased, hashed to 2^bits places; a term counts once in a text, so
long texts aren't diluted.

A first machine gives every term that `rare` training rows have a weight and a factor vector. The
terms to which it gives most are tested in pairs: does one tell the label among the rows that have the
other? So a pair counts even if each of its terms is neutral by itself. The machine that scores has
the terms of such pairs and all those that tell the label alone. It has at most 2^bits rows of
1 + factors numbers (10 MB) at any size of the corpus; it is broadcast.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, scratch, share_code, stored

STEM = 5
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Hasher(dict):
    """Hashed terms of raw words: the word, and the first bytes of longer ones, which compounds share; a bounded memory."""

    def __init__(self, bits: int, most: int = 500_000):
        super().__init__()
        self.mask, self.most = (1 << bits) - 1, most

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        w = raw.strip(STRIP)
        terms = (zlib.crc32(w) & self.mask, *([zlib.crc32(b"^" + w[:STEM]) & self.mask] if len(w) > STEM else [])) if w else ()
        self[raw] = terms
        return terms

    def terms(self, text: str | None) -> np.ndarray:
        """Distinct hashed terms of a whole text, ascending."""
        if len(self) > self.most:
            self.clear()
        found = {t for w in set((text or "").lower().encode().split()) for t in self[w]}
        return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def hashed_terms(text: str | None, bits: int) -> np.ndarray:
    return Hasher(bits).terms(text)


@dataclass
class FactorizationMachine:
    bits: int
    bias: float
    slot: np.ndarray  # place of the hashed term among the weighted ones, or -1
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of texts given by their hashed terms; all at once, by sums over their terms."""
        if not rows:
            return np.zeros(0)
        flat, owner = self.slot[np.concatenate(rows)], np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat, owner = flat[flat >= 0], owner[flat >= 0]
        z = self.bias + np.bincount(owner, self.w[flat], len(rows))
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            z += 0.5 * (np.bincount(owner, x, len(rows)) ** 2 - np.bincount(owner, x * x, len(rows)))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def score(self, text: str | None) -> float:
        return float(self.scores([hashed_terms(text, self.bits)])[0])


def _descent(rows: list[np.ndarray], y: np.ndarray, slot: np.ndarray, n_terms: int, factors: int, rounds: int, rate: float, decay: float, batch: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adagrad on the logistic loss; terms without a slot are left out."""
    n, share, rng = len(y), float(y.mean()), np.random.default_rng(seed)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, factors))
    # Squared gradients start at 1, so that small, noisy ones move little.
    seen_w, seen_v, seen_b = np.ones_like(w), np.ones_like(v), 1.0
    shuffled, batches = rng.permutation(n), []
    for lo in range(0, n, batch):
        at = shuffled[lo : lo + batch]
        flat, owner = slot[np.concatenate([rows[i] for i in at])], np.repeat(np.arange(len(at), dtype=np.int32), [len(rows[i]) for i in at])
        terms, local = np.unique(flat[flat >= 0], return_inverse=True)
        batches.append((y[at], terms, local.astype(np.int32), owner[flat >= 0]))
    for _ in range(rounds):
        for b in rng.permutation(len(batches)).tolist():
            want, terms, local, owner = batches[b]
            m, k, wt, vt = len(want), len(terms), w[terms], v[terms]
            x = vt[local]
            s = np.stack([np.bincount(owner, x[:, f], m) for f in range(factors)], axis=1)
            z = bias + np.bincount(owner, wt[local], m) + 0.5 * ((s * s).sum(axis=1) - np.bincount(owner, (x * x).sum(axis=1), m))
            g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - want
            pull = g[owner]
            gw = np.bincount(local, pull, k) + decay * wt
            gv = np.stack([np.bincount(local, pull * (s[owner, f] - x[:, f]), k) for f in range(factors)], axis=1) + decay * vt
            seen_w[terms] += gw * gw
            seen_v[terms] += gv * gv
            seen_b += g.sum() ** 2
            w[terms] -= rate * gw / np.sqrt(seen_w[terms])
            v[terms] -= rate * gv / np.sqrt(seen_v[terms])
            bias -= rate * float(g.sum() / np.sqrt(seen_b))
    return bias, w, v


def _tied(hit: np.ndarray, seen: np.ndarray, share: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Chi-squared of finding hit positives in seen of among rows whose share of positives is share."""
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hit - seen * share) ** 2 / (seen * share * (1 - share)) / (1 - seen / among)
    return np.where((seen >= 5) & (seen < among) & (share > 0) & (share < 1), chi, 0.0)


def told_terms(rows: list[np.ndarray], y: np.ndarray, bits: int, weight: np.ndarray, least: float, least_pair: float, tested: int) -> np.ndarray:
    """Terms tied to the label alone, and terms of pairs of which one is tied to it among the rows
    that have the other. Pairs are made of the `tested` terms of most weight. Rows that agree in
    everything count once here."""
    first = list({(zlib.crc32(r), len(r), int(r.sum()), float(l)): i for i, (r, l) in enumerate(zip(rows, y, strict=True))}.values())
    rows, y = [rows[i] for i in first], y[first]
    n, size = len(y), np.array([len(r) for r in rows])
    flat, ends = np.concatenate(rows), np.concatenate(([0], np.cumsum(size)))
    df = np.bincount(flat, minlength=1 << bits).astype(float)
    hit = np.bincount(np.concatenate([r for r, l in zip(rows, y, strict=True) if l > 0]), minlength=1 << bits).astype(float)
    alone = _tied(hit, df, np.float64(y.mean()), np.float64(n)) >= least
    some = np.sort(np.argsort(-weight * np.sqrt(df), kind="stable")[:tested])
    some = some[(df[some] >= 5) & (weight[some] > 0)]
    at = np.full(1 << bits, -1, dtype=np.int32)
    at[some] = np.arange(len(some))
    both, positive = np.zeros((len(some), len(some)), dtype=np.float32), np.zeros((len(some), len(some)), dtype=np.float32)
    for lo in range(0, n, 1024):  # a dense piece of the rows at a time
        hi = min(lo + 1024, n)
        column, owner = at[flat[ends[lo] : ends[hi]]], np.repeat(np.arange(hi - lo, dtype=np.int32), size[lo:hi])
        x = np.zeros((hi - lo, len(some)), dtype=np.float32)
        x[owner[column >= 0], column[column >= 0]] = 1
        both += x.T @ x
        positive += x[y[lo:hi] > 0].T @ x[y[lo:hi] > 0]
    told = np.zeros(len(some), dtype=bool)
    for lo in range(0, len(some), 128):  # and of the pairs
        among = df[some[lo : lo + 128]][:, None]
        pair = _tied(positive[lo : lo + 128].astype(float), both[lo : lo + 128].astype(float), hit[some[lo : lo + 128]][:, None] / among, among) >= least_pair
        told |= pair.any(axis=0)
        told[lo : lo + 128] |= pair.any(axis=1)
    paired = some[told]
    return np.union1d(np.flatnonzero(alone), paired)


def fit(
    rows: list[np.ndarray], labels: np.ndarray, bits: int = 18, factors: int = 4, rounds: int = 25, rate: float = 0.1, decay: float = 1e-2, least: float = 15.0, least_pair: float = 40.0,
    rare: int = 10, tested: int = 2000, batch: int = 256, seed: int = 7,
) -> FactorizationMachine:
    """A machine of hashed term rows. Without both labels, the share of label 1 is the score."""
    slot, y = np.full(1 << bits, -1, dtype=np.int32), labels.astype(np.float64)
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    none = FactorizationMachine(bits, float(np.log(max(share, 1e-4) / max(1 - share, 1e-4))), slot, np.zeros(0), np.zeros((0, factors)))
    if n == 0 or share in (0.0, 1.0):
        return none
    if not any(len(r) for r in rows):
        return none
    every = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=1 << bits) >= rare)
    slot[every] = np.arange(len(every))
    _, w, v = _descent(rows, y, slot, len(every), factors, 8, rate, 30 * decay, batch, seed)
    weight = np.zeros(1 << bits)
    weight[every] = np.abs(w) + np.sqrt((v * v).sum(axis=1))
    picked = told_terms(rows, y, bits, weight, least, least_pair, tested)
    slot[:] = -1
    if not len(picked):
        return none
    slot[picked] = np.arange(len(picked))
    bias, w, v = _descent(rows, y, slot, len(picked), factors, rounds, rate, decay, batch, seed)
    return FactorizationMachine(bits, bias, slot, w, v)


def training_sample(docs: DataFrame, labels: DataFrame, most: int = 15_000, most_bytes: int = 64 << 20, bits: int = 18, folds: int = 5, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """doc_id, y, terms (hashed, as bytes): a sample of labelled documents outside the held-out fold.

    Held out are ids whose crc32 as text is 0 mod folds. Rows with a null id or label are left out;
    several labels of an id count as their largest; documents of one id count each, equal ones once.
    The sample has about `most` rows and `most_bytes` bytes of terms at most: above either, the rows of
    least hash are taken.
    """
    spark = docs.sparkSession
    share_code(spark)
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    named = named.where(crc32_of_id(F.col("doc_id")) % folds != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    count = named.count()
    if count > most:
        named = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * most / count))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The labels were cut to about `most`, so the texts need not be shuffled to meet them.
    rows = rows.join(F.broadcast(named), "doc_id").select("doc_id", "y", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for b in batches:
            data = [hasher.terms(x).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["doc_id", "y", "terms"])

    found = stored(rows.mapInArrow(terms, "doc_id long, y int, terms binary").distinct(), scratch(spark))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("terms")), F.lit(0))).first()
    part = min(1.0, most / max(n, 1), most_bytes / max(size, 1))
    if part < 1:
        found = found.where(F.pmod(F.xxhash64("terms", "doc_id"), F.lit(1 << 40)) < int((1 << 40) * part))
    return found


def _unpacked(rows: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed terms and labels of (doc_id, y, terms), in the order of the rows' values."""
    rows = sorted(rows)
    return [np.frombuffer(r[2], dtype=np.int32) for r in rows], np.array([r[1] > 0 for r in rows], dtype=np.int8)


def training_rows(docs: DataFrame, labels: DataFrame, **options) -> tuple[list[np.ndarray], np.ndarray]:
    """The training sample itself, at the driver."""
    return _unpacked(training_sample(docs, labels, **options).collect())


def train(docs: DataFrame, labels: DataFrame, most: int = 15_000, bits: int = 18, **options) -> FactorizationMachine:
    """A machine fitted to the training sample, in one task, as the sample is bounded; only the machine reaches the driver."""
    sample = training_sample(docs, labels, most, bits=bits)

    def fitted(group: pa.Table) -> pa.Table:
        m = fit(*_unpacked(list(zip(*(group.column(c).to_pylist() for c in ("doc_id", "y", "terms")), strict=True))), bits=bits, **options)
        return pa.table([pa.array([pickle.dumps(m)], pa.binary())], names=["machine"])

    made = sample.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "machine binary").first()
    return pickle.loads(made[0]) if made else fit([], np.zeros(0), bits=bits, **options)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5); one row for each input row.

    Texts are read whole. Null and empty texts get the score of no terms. Ids are carried as they
    are, null or repeated; a null id isn't held out. Other columns are not read. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    share_code(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hasher = Hasher(m.bits)
        for b in batches:
            p = m.scores([hasher.terms(x) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), (key.isNotNull() & (crc32_of_id(key) % folds == 0)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """docs whose score is below 0.5, with their own columns; texts don't leave their tasks.

    Null and empty texts have the score of no terms; rows are judged each, whatever their ids. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    share_code(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hasher = Hasher(m.bits)
        for b in batches:
            yield b.filter(pa.array(m.scores([hasher.terms(x) for x in b.column(place).to_pylist()]) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
