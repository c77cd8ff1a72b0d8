"""Token counts and token ids of byte-level BPE tokenizers, in Arrow batches.

A text may be cut before a space that stands between two characters that aren't white space: the
tokenizer's pattern never spans such a place. Distinct pieces recur, so each task encodes a piece
once, many pieces joined into one string of bounded size, and looks it up afterwards. Texts with
other white space at such cuts (double spaces, say) are encoded directly; long ones are split at safe
places first. Both ways give what the library gives for the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, share_code

BATCH_BYTES = 10 << 20
GROUP = 1000
#: White space beside the one space between joined pieces, or at the end.
ODD = re.compile(r"\s\s|\s$").search
JOINED = 32 << 10
MEMORY = 500_000

_LOADED: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with the tokenizers library, special tokens in texts treated as its default."""

    def __init__(self, name: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(tokenizer_path(name) if "/" not in name else name)
        made = json.loads(self.t.to_str())
        before = made.get("pre_tokenizer") or {}
        #: Only byte-level BPE with the usual pattern and nothing before it may be cut at spaces.
        self.cuts = not made.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        size = self.t.get_vocab_size()
        self.starts = np.zeros(size, dtype=bool)
        for piece, i in self.t.get_vocab().items():
            self.starts[i] = piece.startswith("Ġ")  # the byte-level alphabet's space
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for e in self.t.encode_batch_fast(texts, add_special_tokens=False):
            out.append(np.array(e.ids, dtype="<u4").tobytes())
        return out

    def _long(self, text: str) -> bytes:
        """A text with unusual white space, in parts cut at safe places."""
        parts, at = [], 0
        while len(text) - at > JOINED:
            cut = at + JOINED
            while (cut := text.find(" ", cut)) > 0 and not (cut + 1 < len(text) and not text[cut - 1].isspace() and not text[cut + 1].isspace()):
                cut += 1
            if cut <= 0:
                break
            parts.append(text[at:cut])
            at = cut
        return b"".join(self._whole([*parts, text[at:]]))

    def _learn(self, words: list[str]) -> None:
        """Encode pieces that follow a space; each begins with the only token that has the space."""
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        joined = [" " + " ".join(g) for g in groups]
        if any(map(ODD, joined)):  # a piece that is empty or has white space at an end is no safe cut
            words = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
            groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
            joined = [" " + " ".join(g) for g in groups]
        for group, e in zip(groups, self.t.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) == len(group) and cuts[0] == 0:
                raw, places = ids.tobytes(), (4 * cuts).tolist()
                self.known.update(zip(group, [raw[a:b] for a, b in zip(places, [*places[1:], len(raw)], strict=True)], strict=True))
            else:  # not seen with byte-level vocabularies; one by one is always right
                self.known.update(zip(group, self._whole([" " + w for w in group]), strict=True))

    def _fallback(self, text: str) -> bytes:
        return self._long(text) if len(text) > JOINED else self._whole([text])[0]

    def tables(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, begin, length and offsets: text i is the ids at begin[k] to begin[k] + length[k] of
        its pieces k from offsets[i] to offsets[i + 1]. texts holds no null."""
        if not self.cuts:
            whole = self._whole(texts.to_pylist())
            length = np.array([len(x) // 4 for x in whole], dtype=np.int64)
            return np.frombuffer(b"".join(whole), dtype="<u4"), np.cumsum(length) - length, length, np.arange(len(whole) + 1)
        if len(self.known) > MEMORY:  # pieces not met since the last time are forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        split = pc.split_pattern(texts, " ")
        offsets, coded = split.offsets.to_numpy().astype(np.int64), split.values.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        got = list(map(known.get, words))
        gaps = [i for i, x in enumerate(got) if x is None]
        met = {w: older[w] for i in gaps if (w := words[i]) in older}
        known.update(met)
        self._learn([w for i in gaps if (w := words[i]) not in met])
        odd = np.zeros(len(words), dtype=bool)
        for i in gaps:
            if (x := known.get(words[i])) is None:
                odd[i], x = True, b""
            got[i] = x
        firsts = pc.take(coded.dictionary, coded.indices.take(pa.array(offsets[:-1]))).to_pylist()
        # A cut needs a visible character on either side; the first piece stands alone.
        bad = odd[index]
        bad[offsets[:-1]] = np.array([not x or x[-1].isspace() for x in firsts], dtype=bool) & (np.diff(offsets) > 1)
        bad = np.add.reduceat(bad.astype(np.int64), offsets[:-1]) > 0 if len(firsts) else np.zeros(0, dtype=bool)
        heads = self._whole(firsts)
        for i in np.flatnonzero(bad | (np.diff(offsets) == 1)).tolist():
            heads[i] = self._fallback(texts[i].as_py())
        size = np.fromiter(map(len, [*got, *heads]), dtype=np.int64, count=len(got) + len(heads)) // 4
        begin = np.cumsum(size) - size
        entry = index.astype(np.int64)
        entry[offsets[:-1]] = np.arange(len(got), len(got) + len(heads))
        length = size[entry]
        if bad.any():  # their first pieces hold the whole texts
            inside = np.repeat(bad, np.diff(offsets))
            inside[offsets[:-1]] = False
            length[inside] = 0
        return np.frombuffer(b"".join([*got, *heads]), dtype="<u4"), begin[entry], length, offsets

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        _, _, length, offsets = self.tables(texts)
        return np.add.reduceat(length, offsets[:-1]) if len(texts) else length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each."""
        ids, begin, length, offsets = self.tables(texts)
        if not len(texts):
            return ids, length
        kind = np.int32 if length.sum() < 1 << 31 and len(ids) < 1 << 31 else np.int64
        at = np.repeat((begin - (np.cumsum(length) - length)).astype(kind), length)
        at += np.arange(len(at), dtype=kind)
        return ids[at], np.add.reduceat(length, offsets[:-1])


def encoder(name: str) -> Encoder:
    """One for each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(name)
    return _LOADED[name]


def batches_of(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about as many bytes each; a longer text is a range of its own."""
    lo = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); one row for each input row.

    Null texts count as empty: no bytes, no tokens. Long texts are counted whole, split at safe places
    where there are any. Ids are carried as they are, null or repeated; repeated rows are counted each.
    Other columns are not read, so their names don't matter. An empty table gives an empty one.
    Only lengths leave the Arrow function; no data is shuffled.
    """
    share_code(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            n = np.concatenate([np.zeros(0, np.int64), *[enc.counts(texts[lo:hi]) for lo, hi in batches_of(texts)]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
