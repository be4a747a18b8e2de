"""Language identification with a small convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes, the last one padded. In each window filters of widths 2, 3 and 4 run
over embedded bytes, each filter keeps its maximum, and a softmax layer turns the maxima into languages. A document's
answer is the language with the highest mean log-probability over all its windows, weighted by their letters; its
score is the weighted mean probability of that language.

The network is trained in numpy on the driver. For use, embedding and filters are folded into tables over pairs of
byte classes, so a filter costs one or two table rows a byte.

Scale: one pass over the text, no shuffle, bounded slices. The sample that is learned from is bounded by parameters:
the ``MAX_LANGUAGES`` languages with most labelled documents, of each about ``PER_LANGUAGE`` documents by hash of the id
(fewer where the languages are many, so that there are about ``MAX_DOCS`` in all), of each document ``WINDOWS_EACH``
windows spread over the whole text. The model has a fixed size.

Defined results: ``und`` with score 0 for a null text, a text without any letter, or without any labelled training
row; a text of any length is read whole; of languages that tie the first by code point is told; labels that are null are
not learned; an empty table gives an empty result; repeated rows are answered each by itself; other columns are ignored,
whatever their names (and kept by ``keep_identified``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, fold, mapped

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
PER_LANGUAGE = 400
WINDOWS_EACH = 8
MAX_LANGUAGES = 1000
MAX_DOCS = 20_000


def _classes() -> np.ndarray:
    """Byte -> class: 0 padding and controls, 1 blank, 2 digit, 3 other ASCII, 4.. letters, 30.. bytes from 0x80."""
    table = np.full(256, 3, np.uint8)
    table[:32] = 0
    table[[9, 10, 11, 12, 13, 32]] = 1
    table[48:58] = 2
    for i in range(26):
        table[65 + i] = table[97 + i] = 4 + i
    table[128:] = 30 + np.arange(128)
    return table


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1


@dataclass
class Model:
    languages: list[str]
    pairs: list[np.ndarray]  # widths 2, 3, 4 (first two bytes), 4 (last two): class pairs x filters
    single: np.ndarray  # width 3, third byte
    dense: np.ndarray
    bias: np.ndarray


def cut(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW classes, the row of each window)."""
    lengths = at[1:] - at[:-1]
    per = (lengths + WINDOW - 1) // WINDOW
    owner = np.repeat(np.arange(len(lengths)), per)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    out = np.zeros(int(per.sum()) * WINDOW, np.uint8)
    shift = np.repeat(first * WINDOW - at[:-1], lengths)
    out[np.arange(len(flat)) + shift] = CLASS[flat]
    return out.reshape(-1, WINDOW), owner


def pooled(model: Model, codes: np.ndarray, step: int = 256) -> np.ndarray:
    """The maxima of all filters: windows x (widths * filters)."""
    out = np.empty((len(codes), 3 * FILTERS), np.float32)
    p2, p3, p4, q4 = model.pairs
    for a in range(0, len(codes), step):
        c = np.ascontiguousarray(codes[a : a + step].T).astype(np.intp)
        pair = c[:-1] * N_CLASSES + c[1:]
        out[a : a + step, :FILTERS] = p2.take(pair, axis=0).max(axis=0)
        wide = p3.take(pair[:-1], axis=0)
        wide += model.single.take(c[2:], axis=0)
        out[a : a + step, FILTERS : 2 * FILTERS] = wide.max(axis=0)
        wide = p4.take(pair[:-2], axis=0)
        wide += q4.take(pair[2:], axis=0)
        out[a : a + step, 2 * FILTERS :] = wide.max(axis=0)
    return np.maximum(out, 0, out=out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def spans_of(params: dict[str, np.ndarray], codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the embedded bytes under a filter, its answers) at every place of every window."""
    emb = np.lib.stride_tricks.sliding_window_view(params["e"][codes], width, axis=1).transpose(0, 1, 3, 2)
    spans = emb.reshape(len(codes), WINDOW - width + 1, width * DIM)
    return spans, spans @ params[f"w{width}"] + params[f"c{width}"]


def gradients(params: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-likelihood of labels ``y`` for windows ``x``."""
    n, grads, top, best = len(x), {}, [], {}
    for w in WIDTHS:
        spans, h = spans_of(params, x, w)
        best[w] = spans, h.argmax(axis=1)
        top.append(h.max(axis=1))
    z = np.concatenate(top, axis=1)
    act = np.maximum(z, 0)
    p = softmax(act @ params["d"] + params["b"])
    p[np.arange(n), y] -= 1
    p /= n
    grads["d"], grads["b"] = act.T @ p, p.sum(axis=0)
    back = (p @ params["d"].T) * (z > 0)
    grads["e"] = np.zeros_like(params["e"])
    for i, w in enumerate(WIDTHS):
        spans, where = best[w]
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        chosen = spans[np.arange(n)[:, None], where]  # n x filters x (w * DIM)
        grads[f"w{w}"] = np.einsum("nfd,nf->df", chosen, g)
        grads[f"c{w}"] = g.sum(axis=0)
        to_emb = (g[:, :, None] * params[f"w{w}"].T[None]).reshape(n, FILTERS, w, DIM)
        for j in range(w):
            np.add.at(grads["e"], x[np.arange(n)[:, None], where + j], to_emb[:, :, j])
    return grads


def folded(params: dict[str, np.ndarray], languages: list[str]) -> Model:
    """Embedding and filters as tables over pairs of classes."""
    e = params["e"]
    part = {w: [e @ params[f"w{w}"][j * DIM : (j + 1) * DIM] for j in range(w)] for w in WIDTHS}
    table = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(-1, FILTERS), np.float32)
    pairs = [table(part[2][0] + params["c2"], part[2][1]), table(part[3][0] + params["c3"], part[3][1]), table(part[4][0] + params["c4"], part[4][1]), table(part[4][2], part[4][3])]
    return Model(languages, pairs, np.ascontiguousarray(part[3][2], np.float32), params["d"], params["b"])


def train(codes: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> Model:
    rng, k = np.random.default_rng(seed), len(languages)
    params = {"e": rng.normal(0, 0.5, (N_CLASSES, DIM)), "d": rng.normal(0, 0.2, (3 * FILTERS, k)), "b": np.zeros(k)}
    params |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)) for w in WIDTHS} | {f"c{w}": np.zeros(FILTERS) for w in WIDTHS}
    params = {n: p.astype(np.float32) for n, p in params.items()}
    mean, square, t = {n: np.zeros_like(p) for n, p in params.items()}, {n: np.zeros_like(p) for n, p in params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for s in range(0, len(order), batch):
            t += 1
            for name, g in gradients(params, codes[order[s : s + batch]], labels[order[s : s + batch]]).items():
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                params[name] -= rate * (mean[name] / (1 - 0.9**t)) / (np.sqrt(square[name] / (1 - 0.999**t)) + 1e-8)
    return folded(params, languages)


def predict(model: Model | None, flat: np.ndarray, at: np.ndarray, texts) -> tuple[list[str], np.ndarray]:
    """Per row the language and its score. texts(i) gives a row's text, asked for only where no plain letter is seen."""
    n = len(at) - 1
    if model is None or not n:
        return ["und"] * n, np.zeros(n)
    codes, owner = cut(flat, at)
    logits = pooled(model, codes) @ model.dense + model.bias
    prob = softmax(logits.astype(np.float64))
    ascii_letters = np.concatenate([[0], np.cumsum((CLASS[flat] >= 4) & (flat < 128))])
    plain = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    lengths = at[1:] - at[:-1]
    weight = ((codes >= 4).sum(axis=1) + 1e-3)[:, None]
    total = np.zeros((n, len(model.languages)))
    mass = np.zeros((n, len(model.languages)))
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.searchsorted(owner, full)
        total[full] = np.add.reduceat(weight * np.log(prob + 1e-12), starts, axis=0)
        mass[full] = np.add.reduceat(weight * prob, starts, axis=0) / np.add.reduceat(weight, starts, axis=0)
    best = total.argmax(axis=1)
    said, score = [model.languages[b] for b in best], mass[np.arange(n), best].clip(0, 1)
    for i in np.flatnonzero(~plain):
        if not any(c.isalpha() for c in texts(i) or ""):
            said[i], score[i] = "und", 0.0
    return said, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (3, 1), per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """Learn from labelled documents whose crc32 fold (of ``held_out[0]``) is not ``held_out[1]``."""
    labelled = docs.where(F.col(lang_col).isNotNull() & (fold(F.col(id_col), held_out[0]) != held_out[1]))
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("l")).count().orderBy(F.desc("count"), "l").limit(max_languages).collect()}
    if not counts:
        return None
    each = min(per_language, max(1, MAX_DOCS // len(counts)))
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1 << 31, int(each / n * (1 << 31)))))))
    picked = labelled.where(F.map_contains_key(share, F.col(lang_col))).where(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1 << 31)) < share[F.col(lang_col)])

    def sample(source: Iterator[pa.RecordBatch]):
        for batch, flat, at in batches(source, "text"):
            codes, owner = cut(flat, at)
            filled = (codes != 0).sum(axis=1) >= min(32, WINDOW)
            langs, out_l, out_w = batch.column(0).to_pylist(), [], []
            for i in range(batch.num_rows):
                a, b = np.searchsorted(owner, [i, i + 1])
                own = np.arange(a, b)
                own = own[filled[a:b]] if filled[a:b].any() else own
                for k in own[np.unique(np.linspace(0, len(own) - 1, WINDOWS_EACH).astype(int))] if len(own) else ():
                    out_l.append(langs[i])
                    out_w.append(codes[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_l, pa.string()), pa.array(out_w, pa.binary())], names=["lang", "codes"])

    rows = sorted((r["lang"], bytes(r["codes"])) for r in mapped(picked.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), sample, "lang string, codes binary").collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    codes = np.frombuffer(b"".join(c for _, c in rows), np.uint8).reshape(-1, WINDOW)
    return train(codes, np.array([languages.index(lang) for lang, _ in rows]), languages)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def run(source):
        for batch, flat, at in batches(source, "text"):
            said, score = predict(model, flat, at, lambda i, column=batch.column(2): column[int(i)].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), held_out[0]) == held_out[1]).alias("held_out"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    return identify(docs, fit(docs, id_col, text_col, lang_col, **options), id_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The documents, all columns, whose language is told with a score of at least ``least``."""
    model, place = fit(docs, id_col, text_col, lang_col), docs.columns.index(text_col)

    def run(source):
        for batch, flat, at in batches(source, text_col):
            said, score = predict(model, flat, at, lambda i, column=batch.column(place): column[int(i)].as_py())
            yield batch.filter(pa.array((score >= least) & (np.array(said) != "und")))

    return mapped(docs, run, docs.schema)
