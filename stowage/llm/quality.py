"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts over the bytes and words of a whole text, computed for many texts at once. Trees are grown
level by level from histograms of gradients and flattened into arrays (feature, threshold, leaf value by heap
position), so that all trees of all rows are walked with a few array operations a level.

Scale: one pass over the text, which keeps ``N_FEATURES`` numbers a document; training takes at most ``max_rows``
labelled rows (the bound of the sample; the first by hash of their id), and the trees have a fixed size. No text is
shuffled.

Defined results: a null text counts as empty and is scored like any other; a text of any length is read whole, one slice
of texts at a time; a statistic that equals a threshold goes left, and of equal splits the first feature's counts;
without labelled rows every score is 0.5; with one class it is that class's prior; of repeated labels for one id the
lowest counts; an empty table gives an empty result; repeated documents are scored each by itself; labels, lang, source
and doc_id are no inputs of a score, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.bytewords import GAPS, mix, shingle_hashes, word_hashes, words
from stowage.llm.common import batches, fold, mapped, stored

MAX_ROWS = 20_000
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.2
CUT = 0.3

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"|", b"\n", b"\"'()[]{}-_/\\=+~^@`"]
_TABLE = np.full(256, len(_GROUPS) + 1, np.uint8)
for _i, _g in enumerate(_GROUPS):
    _TABLE[list(_g)] = _i
_TABLE[128:] = len(_GROUPS)
N_FEATURES = len(_GROUPS) + 2 + 13


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has."""
    both = np.unique(mix(keys + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)), return_index=True)[1]
    return np.bincount(owner[both], minlength=n).astype(np.float64)


def statistics(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x N_FEATURES."""
    n, size = len(at) - 1, np.diff(at).astype(np.float64)
    per_byte = np.maximum(size, 1)
    kinds = _TABLE[flat]
    out = [_sums(kinds == k, at) / per_byte for k in range(len(_GROUPS) + 2)]
    w = words(flat, at)
    count = np.diff(w.first).astype(np.float64)
    per_word = np.maximum(count, 1)
    length = (w.end - w.start).astype(np.float64)
    h = word_hashes(flat, w)
    mean = _sums(length, w.first) / per_word
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (w.owner[1:] == w.owner[:-1])
    upper = kinds[w.start] == 0 if len(h) else np.zeros(0, bool)
    last = flat[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    ends_plain = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    three = shingle_hashes(h, 3)
    whole = w.owner[2:] == w.owner[: len(three)] if len(three) else np.zeros(0, bool)
    windows = np.maximum(count - 2, 1)
    lines = words(flat, at, _LINE_GAPS)
    line_count = np.diff(lines.first).astype(np.float64)
    per_line = np.maximum(line_count, 1)
    out += [
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(_sums(length * length, w.first) / per_word - mean * mean, 0)),
        _distinct(h, w.owner, n) / per_word, _sums(same, w.first) / per_word,
        np.where(count > 2, _distinct(three[whole], w.owner[: len(three)][whole], n) / windows, 1.0),
        _sums(upper, w.first) / per_word, _sums(ends_plain, w.first) / per_word, _sums(length == 1, w.first) / per_word,
        line_count / np.maximum(count, 1), _distinct(word_hashes(flat, lines), lines.owner, n) / per_line, _sums(GAPS[flat], at) / per_byte,
    ]
    return np.stack(out, axis=1).astype(np.float32)


_LINE_GAPS = np.zeros(256, bool)
_LINE_GAPS[10] = True


@dataclass
class Forest:
    """Complete trees of one depth: trees x (2**depth - 1) features and thresholds, trees x 2**depth leaf values."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        if len(x) and len(self.feature):
            depth = int(np.log2(self.value.shape[1]))
            tree, row = np.arange(len(self.feature))[None], np.arange(len(x))[:, None]
            for a in range(0, len(x), 8192):
                part, node = x[a : a + 8192], np.zeros((min(8192, len(x) - a), len(self.feature)), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (part[row[: len(part)], self.feature[tree, node]] > self.threshold[tree, node])
                margin[a : a + 8192] += self.value[tree, node - (2**depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 1.0) -> Forest:
    none = np.zeros((0, 2**depth - 1))
    if not len(y):
        return Forest(0.0, none.astype(int), none, np.zeros((0, 2**depth)))
    p = (y.sum() + 0.5 * (0 < y.sum() < len(y))) / len(y)
    start = float(np.log(max(p, 1e-4) / max(1 - p, 1e-4))) if 0 < y.sum() < len(y) else (6.0 if y[0] else -6.0)
    if not 0 < y.sum() < len(y):
        return Forest(start, none.astype(int), none, np.zeros((0, 2**depth)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin b: x <= cut b
    margin, forest = np.full(len(y), start), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, node = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf, np.float32), np.zeros(len(y), int)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            local = node - base
            best = np.zeros(width)
            chosen = [None] * width
            for f, c in enumerate(cuts):
                key = local * bins + binned[:, f]
                sg = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), axis=1)
                sh = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                gain[(sh < least) | (th - sh < least)] = 0
                gain[:, len(c) :] = 0
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best + 1e-9):
                    best[k], chosen[k] = gain[k, at[k]], (f, at[k])
            for k, pick in enumerate(chosen):
                if pick:
                    feature[base + k], threshold[base + k] = pick[0], cuts[pick[0]][pick[1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        for kept, made in zip(forest, (feature, threshold, value), strict=True):
            kept.append(made)
    return Forest(start, *(np.array(k) for k in forest))


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, stats (N_FEATURES 32-bit floats, packed)."""

    def run(source):
        for batch, flat, at in batches(source, "text"):
            x = np.ascontiguousarray(statistics(flat, at))
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 4 * N_FEATURES).astype(np.int32)), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "held_out", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), 5) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, held_out boolean, stats binary")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stats = stored(featured(docs, id_col, text_col))
    chosen = labels.where(F.col(label_col).isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy(F.col("doc_id").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = stats.join(F.broadcast(chosen), stats["doc_id"] == chosen["id"]).select("id", "y", "stats").orderBy("id", "stats").limit(max_rows).collect()
    x = np.frombuffer(b"".join(bytes(r["stats"]) for r in rows), np.float32).reshape(-1, N_FEATURES)
    forest = grow(x, np.array([float(r["y"] > 0) for r in rows]))

    def run(source):
        for batch in source:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, N_FEATURES)
            score = forest.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(stats, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
