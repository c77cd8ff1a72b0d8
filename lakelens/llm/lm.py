"""Language-model scores by a weighted backoff automaton, trained on the corpus it scores.

States are the empty history and every word and pair of words seen in training (histories of the
three orders); the start of a text is a state, too. Every n-gram seen in training is an arc of its
history's state; any other word takes that state's failure arc, to the history without its first
word, until a word's own arc from the empty history is reached. Weights are those of a hierarchical
Dirichlet model, which sums to one in every state:

    p(w) = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m),  failure arc of h: m / (c(h) + m)

with h' = h without its first word and m the strength of the order. One left-to-right pass over a
text carries the state and adds up log10 weights of the arcs taken; the texts of a block go side by
side, a token of each a step.

Counts grow with the corpus and are never gathered: texts are cut into blocks of bounded bytes. A
block sends its distinct n-grams, as sorted hashes coded by differences, to the parts of the hash
space, and each part sends the corpus counts back in the order of the question, so answers carry no
keys. A part holds about PART entries at any size of the corpus; an n-gram that every block has costs
its part one entry a block. Words go by 64-bit hashes, longer n-grams by GRAM_BITS bits: with n
distinct n-grams, one in 2^GRAM_BITS / n shares its count with another. On a large cluster raise
block_bytes and PART with the executors' memory, so that a block's share of a part stays above some
tens of entries.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, release, scratch, share_code, stored

BLOCK_BYTES = 8 << 20
PART = 1 << 21
GRAM_BITS = 56
WORDS, GRAMS = 1, 2  # kinds of questions
_BLOCKS = "block long, ids binary, missing binary, held binary, lengths binary, words binary, vocabulary binary, train_tokens long, n_words long, n_grams long"


def _key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


END = _key(b"")  # no word is empty


def _coded(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte plane by byte plane, without planes that are zero throughout."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(words: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before each token (the end token before a first), and hashes of the pair and triple that end there.

    A first token has no triple; its place holds the pair again.
    """
    before = np.empty_like(words)
    before[0], before[1:] = 0, words[:-1]  # a text ends with place 0, which is where the next one starts
    h = vocabulary.view(np.uint64)
    pairs = _mixed(h[before] * np.uint64(0x9E3779B97F4A7C15) + h[words])
    triples = np.empty_like(pairs)
    triples[1:] = _mixed(pairs[:-1] * np.uint64(0x94D049BB133111EB) + h[words[1:]])
    first = np.cumsum(lengths.astype(np.int64)) - lengths
    triples[first] = pairs[first]
    cut = np.uint64(64 - GRAM_BITS)
    return before, pairs >> cut, triples >> cut


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts as places in the block's own vocabulary, in rows of bounded size."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    place: defaultdict = defaultdict()

    def fresh() -> tuple:
        place.clear()
        place.default_factory = place.__len__
        place[b""]  # the end token is place 0
        return [], [], [], []

    ids, held, lengths, words = fresh()

    def row() -> pa.RecordBatch:
        flat = np.concatenate(words)
        train = int(sum(n for n, h in zip(lengths, held, strict=True) if not h))
        vocabulary = np.fromiter(map(_key, place), dtype=np.int64, count=len(place))
        values = [
            (part << 24) + seq, np.array([x or 0 for x in ids], dtype=np.int64).tobytes(), np.array([x is None for x in ids], dtype=np.uint8).tobytes(),
            np.array(held, dtype=np.uint8).tobytes(), np.array(lengths, dtype=np.uint32).tobytes(), _coded(flat),
            vocabulary.tobytes(), train, len(vocabulary), 2 * len(flat),
        ]
        kinds = [pa.int64(), *[pa.binary()] * 6, *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    for b in batches:
        for key, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = (text.as_py() or "").encode().lower()
            found = raw.split()
            w = np.zeros(len(found) + 1, dtype=np.uint32)
            w[:-1] = np.fromiter(map(place.__getitem__, found), dtype=np.uint32, count=len(found))
            ids.append(key)
            held.append(h)
            lengths.append(len(w))
            words.append(w)
            size += len(raw)
            if size >= block_bytes:
                yield row()
                seq, size = seq + 1, 0
                ids, held, lengths, words = fresh()
    if ids:
        yield row()
    del ids, held, lengths, words, place
    release()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of blocks, one in memory at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
        del b
    release()


def _opened(row: dict) -> tuple:
    """lengths, held, words, vocabulary of a block, and whether each token is for training."""
    lengths, held = np.frombuffer(row["lengths"], dtype=np.uint32), np.frombuffer(row["held"], dtype=np.uint8)
    words = _decoded(row["words"]).astype(np.int64)
    return lengths, held, words, np.frombuffer(row["vocabulary"], dtype=np.int64), np.repeat(held == 0, lengths)


def _asked(batches: Iterator[pa.RecordBatch], parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The distinct words and n-grams of each block, with their counts in training texts, by part of the hash space."""
    for r in _each(batches):
        lengths, _, words, vocabulary, train = _opened(r)
        n = np.bincount(words[train], minlength=len(vocabulary))
        order = np.argsort(vocabulary.view(np.uint64))
        questions = [(WORDS, 64, vocabulary.view(np.uint64)[order], n[order])]
        _, pairs, triples = _grams(words, lengths, vocabulary)
        first = np.zeros(len(words), dtype=bool)
        first[np.cumsum(lengths.astype(np.int64)) - lengths] = True
        keys, inverse = np.unique(np.concatenate((pairs, triples)), return_inverse=True)
        counted = np.concatenate((train, train & ~first))
        questions.append((GRAMS, GRAM_BITS, keys, np.bincount(inverse[counted], minlength=len(keys))))
        del pairs, triples, inverse, counted
        for kind, bits, keys, counts in questions:
            edges = np.array([(p << bits) // parts[kind] for p in range(parts[kind])], dtype=np.uint64)
            at = np.append(np.searchsorted(keys, edges), len(keys))
            for p in np.flatnonzero(np.diff(at)).tolist():
                some = slice(at[p], at[p + 1])
                deltas = np.diff(keys[some], prepend=edges[p])
                values = [[kind], [p], [r["block"]], [_coded(deltas)], [_coded(counts[some])]]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["kind", "part", "asker", "keys", "counts"])


def _counted(group: pa.Table) -> pa.Table:
    """The corpus counts of all that was asked in a part, in each question's own order."""
    questions = [_decoded(x.as_py()).cumsum(dtype=np.uint64) for x in group.column("keys")]
    counts = np.concatenate([_decoded(x.as_py()) for x in group.column("counts")])
    ends = np.cumsum([len(x) for x in questions])
    keys = np.concatenate(questions)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], np.diff(keys[order]) != 0))
    totals = np.add.reduceat(counts[order], np.flatnonzero(new))
    out = np.empty_like(counts)
    out[order] = totals[np.cumsum(new) - 1]
    found = np.zeros(len(questions), dtype=np.int64)
    found[0] = np.count_nonzero(totals)
    answers = [_coded(x) for x in np.split(out, ends[:-1])]
    columns = [group.column("asker"), group.column("kind"), group.column("part"), pa.array(answers, pa.binary()), pa.array(found)]
    return pa.table(columns, names=["block", "kind", "part", "counts", "found"])


def walked(weights: np.ndarray, states: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The sum of weights along each text. Row s of weights holds, for each token, the weight of the
    path from a state of order s over its failure arcs to the token's arc; states holds the order of
    the state that the arc leads to."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    left = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")  # texts longer than t
    at, total = np.full(len(lengths), start, dtype=np.int64), np.zeros(len(lengths))
    for t, k in enumerate(left.tolist()):
        i = first[:k] + t
        total[:k] += weights[at[:k], i]
        at[:k] = states[i]
    out = np.empty_like(total)
    out[order] = total
    return out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, strengths: tuple[float, float] = (300.0, 5.0), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Held-out texts (crc32 of the id as text mod folds is held_fold) are scored but not learnt. Null
    and empty texts are an end token alone. A text longer than block_bytes is a block of its own. A
    null id isn't held out; repeated rows each count. If nothing is for training, every probability
    is that of the one unknown word, 1. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    share_code(spark)
    path = scratch(spark)
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), (key.isNotNull() & (crc32_of_id(key) % folds == held_fold)).cast("int").alias("held"), F.col(text_col).cast("string").alias("text"))
    # Bucketed by block, the table meets the answers without another shuffle of the texts.
    name, buckets = f"lm_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), _BLOCKS)
    cut.write.format("parquet").option("path", f"{path}/blocks").bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    blocks = spark.table(name)
    total, words, grams = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("train_tokens", "n_words", "n_grams")]).first()
    parts = {WORDS: max(1, -(-words // PART)), GRAMS: max(1, -(-grams // PART))}
    asked = blocks.mapInArrow(lambda batches: _asked(batches, parts), "kind int, part int, asker long, keys binary, counts binary")
    answers = asked.groupBy("kind", "part").applyInArrow(_counted, "block long, kind int, part int, counts binary, found long")
    answers = stored(answers, f"{path}/answers")
    distinct = answers.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]
    unit = total + distinct + 1  # N + 1 * (V + 1)
    second, third = strengths

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        (r,) = left.to_pylist()
        told = {kind: [] for kind in (WORDS, GRAMS)}
        for kind, part, data in sorted(zip(*(right.column(c).to_pylist() for c in ("kind", "part", "counts")), strict=True)):
            told[kind].append(_decoded(data).astype(np.float64))
        lengths, held, words, vocabulary, _ = _opened(r)
        lengths = lengths.astype(np.int64)
        own = np.empty(len(vocabulary))
        own[np.argsort(vocabulary.view(np.uint64))] = np.concatenate(told[WORDS])
        before, pairs, triples = _grams(words, lengths, vocabulary)
        _, inverse = np.unique(np.concatenate((pairs, triples)), return_inverse=True)
        both = np.concatenate(told[GRAMS])[inverse]
        del pairs, triples, inverse, told
        starts = np.cumsum(lengths) - lengths
        c1, c2, c3 = own[words], both[: len(words)], both[len(words) :]
        c3[starts] = 0.0  # a first token has no triple
        h1 = own[before]
        h2 = np.concatenate(([0.0], c2[:-1]))
        # From each state, by way of its failure arcs, to the arc of the token that comes.
        p1 = (c1 + 1) / unit
        p2 = (c2 + second * p1) / (h1 + second)
        p3 = (c3 + third * p2) / (h2 + third)
        weights = np.empty((3, len(words)))
        weights[0] = np.log10(p1)
        weights[1] = np.where(c2 > 0, np.log10(p2), np.log10(second / (h1 + second)) + weights[0])
        weights[2] = np.where(c3 > 0, np.log10(p3), np.log10(third / (h2 + third)) + weights[1])
        states = np.where(c2 > 0, 2, np.where(c1 > 0, 1, 0))
        score = walked(weights, states, lengths, int(own[0] > 0))
        ids = np.frombuffer(r["ids"], dtype=np.int64)
        columns = [
            pa.array(ids, mask=np.frombuffer(r["missing"], dtype=np.uint8).astype(bool)), pa.array(held.astype(bool)), pa.array(lengths),
            pa.array(np.add.reduceat((c1 > 0).astype(np.int64), starts)), pa.array(np.full(len(ids), total, dtype=np.int64)),
            pa.array(np.add.reduceat(weights[0], starts)), pa.array(score),
        ]
        del weights, both, c1, c2, c3, h1, h2, p1, p2, p3
        release()
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
