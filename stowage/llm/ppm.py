"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The trie holds the counts of every symbol after every context of 0 to ``ORDER`` bytes in the training documents (a
text is preceded by ``ORDER`` null bytes and followed by an end symbol). A symbol is coded in its longest known
context; where it is new there, an escape (method C: as many escapes as different symbols) leads to the next shorter
context, whose symbols already ruled out are excluded. The score is the log10 probability of the text and its end.

A node is a context and a symbol packed into one 64-bit number, so that a trie is a few sorted arrays, scoring looks
up all positions of many texts at once, and the counts of shorter contexts are sums over the longest ones.

Beside the score stands a unigram base over words. Words are counted as 64-bit hashes; the ``HEAD`` commonest words
are looked up in a table of that size, all others meet their counts in a join, so every word counts exactly.

A symbol's probability depends on the ``ORDER`` bytes before it alone, so it is worked out once for every place that
occurs anywhere: places are dealt out by their last three context bytes, and a task builds the trie of its own contexts
below the counts of order 0 to 2, which are sent to all tasks (one per string of three bytes that occurs). The ``NODES`` commonest places are looked up in a table of that
size, all others meet their probability in a join, as rare words do; no node is left out.

Scale: two passes over the text, which is never shuffled. What the corpus gives is counted whole, each task adding up
what it has before the shuffle. A task holds the places of one string of three context bytes at a time, and at least ``CHUNK``.

Defined results: a null text is empty (one token, the end); a text of any length is scored whole, one slice of texts at a
time; counts that tie are the same node's or go together to the table or to the join, with the same result; without
training documents every symbol has the probability 1/256 and the base is that of no counts; an empty table gives an
empty result; repeated rows are rows of their own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.bytewords import LOWER, word_hashes, words
from stowage.llm.common import batches, fold, mapped, stored

ORDER = 5
NODES = 2 << 20
HEAD = 1 << 20
CHUNK = 1 << 19
END = 255
#: Context bytes that places are dealt out by, and the mask of as many bytes.
DEALT = 3
LOW = (1 << 8 * DEALT) - 1
#: The hash of the token that ends a text.
END_WORD = np.uint64(0x0123456789ABCDEF)
_B = np.uint64(8)


def framed(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places as contexts and symbols: keys (ORDER bytes before, then the symbol), and where each row's begin."""
    rows = len(at) - 1
    size = np.diff(at)
    padded = np.zeros(len(flat) + rows * (ORDER + 1), np.uint64)
    begin = at[:-1] + np.arange(rows) * (ORDER + 1) + ORDER
    padded[np.arange(len(flat)) + np.repeat(begin - at[:-1], size)] = flat
    padded[begin + size] = END
    keys = padded[ORDER:].copy()
    for k in range(1, ORDER + 1):
        keys |= padded[ORDER - k : len(padded) - k] << np.uint64(8 * k)
    kept = np.ones(len(keys), bool)
    if rows > 1:
        kept[(begin[1:, None] - 2 * ORDER + np.arange(ORDER)[None]).ravel()] = False
    return keys[kept], at[:-1] + np.arange(rows)


def tally(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[edge], np.add.reduceat(times, edge) if len(edge) else times


class Counter:
    """Adds up keys of many slices; ``full`` tells when it holds so many that they had better be sent on."""

    def __init__(self, most: int = 4_000_000):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(tally(keys))
        self.held += len(self.parts[-1][0])
        if self.held > self.most // 2:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [tally(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
        self.held = sum(len(k) for k, _ in self.parts)

    @property
    def full(self) -> bool:
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        return out


class Table:
    """Positions of 64-bit keys, in buckets of a hash; -1 for others. It takes 16 to 20 bytes a key, on its way by broadcast too."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))))
        self.shift = np.uint64(64 - bits)
        slot = self.slots(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.place = np.append(keys[order], np.uint64(0)), np.append(order.astype(np.int32), np.int32(-1))
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << bits), out=self.start[1:])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        at = self.start[slot]  # a bucket without keys leads to a key of another one, which is none of these
        hit = self.keys[at] == keys
        out = np.where(hit, self.place[at], np.int32(-1))
        at += 1
        left = np.flatnonzero(~hit & (at < self.start[slot + 1]))
        at, end = at[left], self.start[slot[left] + 1]
        while len(left):
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.place[at[hit]]
            more = ~hit & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return out


@dataclass
class Level:
    symbols: Table  # context and symbol
    n: np.ndarray
    plain: np.ndarray  # log10 of n / (total + different), where nothing is excluded
    contexts: Table
    escape: np.ndarray  # log10 of the escape, where nothing is excluded
    rest: np.ndarray  # total + different one order lower, without the symbols seen here; 0: none is left
    rest_escape: np.ndarray


class Trie:
    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        """orders: for each order from 0 on, sorted keys and counts."""
        self.levels: list[Level] = []
        before: tuple[np.ndarray, np.ndarray, np.ndarray, Table, Table, np.ndarray] | None = None
        for keys, n in orders:
            n = n.astype(np.float64)
            context = keys >> _B
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
            own = np.cumsum(np.concatenate([[0], (context[1:] != context[:-1]).astype(int)])) if len(keys) else np.zeros(0, int)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            different = np.diff(np.append(first, len(keys))).astype(np.float64)
            known, symbols, nodes = context[first], Table(keys), None
            order = len(self.levels)
            if before is None:  # below order 0 all symbols are equally likely
                rest, rest_escape = 256 - different, np.zeros(len(first))
            else:
                lower = np.uint64((1 << (8 * order)) - 1)
                n_low, total_low, different_low, low_symbols, low_contexts = before
                at = low_contexts.find(known & (lower >> _B))
                seen = np.bincount(own, n_low[low_symbols.find(keys & lower)], len(first)) if len(first) else total
                d = different_low[at] - different
                rest = total_low[at] - seen + d
                rest_escape = np.log10(np.maximum(d, 1e-300) / np.maximum(rest, 1e-300), where=d > 0, out=np.zeros(len(d)))
            nodes = Table(known)
            self.levels.append(Level(symbols, n, np.log10(n / (total + different)[own]) if len(n) else n, nodes, np.log10(different / (total + different)), rest, rest_escape))
            before = n, total, different, symbols, nodes

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's symbol after its context."""
        out = np.zeros(len(keys))
        top = len(self.levels) - 1
        at = self.levels[top].symbols.find(keys) if top >= 0 else np.full(len(keys), -1, np.int32)
        if top >= 0:
            out = np.where(at >= 0, self.levels[top].plain[at] if len(self.levels[top].plain) else 0.0, 0.0)
        todo = np.flatnonzero(at < 0)
        if not len(todo):
            return out
        key, total = keys[todo], np.zeros(len(todo))
        left, above = np.arange(len(todo)), np.full(len(todo), -1)
        for order in range(top, -1, -1):
            level, mask = self.levels[order], np.uint64((1 << (8 * (order + 1))) - 1)
            k = key[left] & mask
            if order < top:
                upper = self.levels[order + 1]
                at = level.symbols.find(k)
                hit = at >= 0
                got, up = left[hit], above[left[hit]]
                n = level.n[at[hit]]
                total[got] += np.where(up >= 0, np.log10(n / np.maximum(upper.rest[up], 1)), level.plain[at[hit]]) if len(got) else 0
                left, k = left[~hit], k[~hit]
            node = level.contexts.find(k >> _B)
            up = above[left]
            if order < top and len(left):
                total[left] += np.where(node >= 0, np.where(up >= 0, upper.rest_escape[up], level.escape[node]), 0)
            elif len(left) and len(level.escape):
                total[left] += np.where(node >= 0, level.escape[node], 0)
            above[left] = node
        if len(left):
            lowest = self.levels[0].rest if self.levels else np.zeros(0)
            total[left] -= np.log10(np.where(above[left] >= 0, lowest[above[left]] if len(lowest) else 256.0, 256.0))
        out[todo] = total
        return out

    def score(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys, first = framed(flat, at)
        return np.add.reduceat(self.logs(keys), first) if len(first) else np.zeros(0)


def shorter(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of contexts of ``order`` bytes from those of longer ones."""
    return tally(keys & np.uint64((1 << (8 * (order + 1))) - 1), n)


def trie(keys: np.ndarray, n: np.ndarray, order: int = ORDER) -> Trie:
    return Trie([shorter(keys, n, k) for k in range(order + 1)] if len(keys) else [])


# --- over tables -------------------------------------------------------------------------------------------------

GRAM, WORD = 0, 1
#: Rows that a task hands over at once.
ROWS = 1 << 16


def _pieces(batch: pa.RecordBatch):
    """Slices of ``ROWS`` rows, for the JVM holds a batch whole."""
    return (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))


def _rows(kind: int, keys: np.ndarray, n: np.ndarray, every: np.ndarray):
    return _pieces(pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(every.astype(np.int64))], names=["kind", "key", "n", "every"]))


def _places(train: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]):
    """Rows of the places of training documents and of the others, one a key."""
    (keys, n), (more, times) = train, others
    at = np.searchsorted(keys, more)
    both = at < len(keys)
    both[both] = keys[at[both]] == more[both]
    every = n.copy()
    every[at[both]] += times[both]
    yield from _rows(GRAM, keys, n, every)
    yield from _rows(GRAM, more[~both], np.zeros_like(times[~both]), times[~both])


def _count(source):
    """What one task finds: (kind, key, n in training documents, n in all); words of training documents alone."""
    train, others, common, ends = Counter(), Counter(1_000_000), Counter(2_000_000), 0
    for batch, flat, at in batches(source, "text"):
        held = batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
        keys, w = framed(flat, at)[0], words(flat, at)
        apart = np.repeat(held, np.diff(at) + 1)
        train.add(keys[~apart])
        others.add(keys[apart])
        common.add(word_hashes(LOWER[flat], w)[~held[w.owner]])
        ends += int((~held).sum())
        if train.full or others.full:
            yield from _places(train.take(), others.take())
        if common.full:
            keys, n = common.take()
            yield from _rows(WORD, keys, n, n)
    yield from _places(train.take(), others.take())
    keys, n = common.take()
    yield from _rows(WORD, keys, n, n)
    n = np.array([ends] * bool(ends), np.int64)
    yield from _rows(WORD, np.array([END_WORD] * bool(ends), np.uint64), n, n)


def solved(keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each place; for any ``DEALT`` context bytes either all places are there or none."""
    known = n > 0
    orders = [*(shorter(*low, k) for k in range(DEALT - 1)), low] if len(low[0]) else []
    if not known.any():
        return Trie(orders).logs(keys & np.uint64(LOW))
    train = tally(keys[known], n[known])
    return Trie([*orders, *(shorter(*train, k) for k in range(DEALT, ORDER)), train]).logs(keys)


def _solve(shared):
    """Over (key, n, every) sorted by the last ``DEALT`` context bytes: (key, every, p). shared: counts of the orders below."""

    def run(source):
        parts, held, enough = [], 0, CHUNK
        for batch in source:
            if not batch.num_rows:
                continue
            parts.append([np.asarray(batch.column(i)) for i in range(3)])
            held += batch.num_rows
            if held >= enough:
                key, n, every = (np.concatenate(c) for c in zip(*parts, strict=True))
                last = int(np.searchsorted((key >> 8) & LOW, (key[-1] >> 8) & LOW))
                parts, held = [[key[last:], n[last:], every[last:]]], len(key) - last
                enough = max(CHUNK, 2 * held)
                if last:
                    yield from answer(key[:last], n[:last], every[:last])
        if held:
            yield from answer(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    def answer(key, n, every):
        return _pieces(pa.RecordBatch.from_arrays([pa.array(key), pa.array(every), pa.array(solved(key.view(np.uint64), n, shared.value))], names=["key", "n", "p"]))

    return run


def _rare(keys: np.ndarray, owner: np.ndarray, size: int) -> list[pa.ListArray]:
    """For each of ``size`` rows its different keys and how often it has them."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, int)
    times = np.diff(np.append(edge, len(keys)))
    offsets = pa.array(np.searchsorted(owner[edge], np.arange(size + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in (keys[edge].view(np.int64), times)]


def _commonest(table: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts, at most ``most`` of them: those whose step of counts (a 16th of a doubling) is whole."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 16).cast("int")
    seen = {r[0]: r[1] for r in table.where("n > 0").groupBy(step.alias("c")).count().collect()}  # at most 1,024 rows
    least, total = max(seen, default=0) + 1, 0
    for c in sorted(seen, reverse=True):
        total += seen[c]
        if total > most:
            break
        least = c
    return table.where((F.col("n") > 0) & (step >= least))


def _arrays(table: DataFrame, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """key and value, sorted by the unsigned key; for tables of checked size."""
    got = table.select("key", value).toArrow()
    keys, n = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(c) for c in got.column(i).chunks)]) for i in (0, 1))
    keys = keys.view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], n[order]


def counts_of(rows: DataFrame) -> DataFrame:
    """(kind, key, n, every) of (text, held_out). A task has added up its keys already, so they are dealt out as they are: another map of them in the JVM would only hold them again."""
    counted = mapped(rows.select("text", "held_out"), _count, "kind int, key long, n long, every long")
    return counted.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), 10) == 0).alias("held_out"), F.col(text_col).alias("text"))
    counts = stored(counts_of(rows))
    tokens = counts.where(f"kind = {WORD}").select("key", "n")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = tokens.where(F.col("key") == int(END_WORD)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    grams = counts.where(f"kind = {GRAM}").select("key", "n", "every")
    low = _arrays(grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(LOW)).alias("key")).agg(F.sum("n").alias("n")))
    dealt = grams.withColumn("by", F.shiftright("key", 8).bitwiseAND(F.lit(LOW))).repartition("by").sortWithinPartitions("by").select("key", "n", "every")
    lower = spark.sparkContext.broadcast(low)
    places = stored(mapped(dealt, _solve(lower), "key long, n long, p double"))
    lower.destroy()
    (place_keys, p), (word_keys, n) = _arrays(_commonest(places, nodes), "p"), _arrays(_commonest(tokens, head))
    model = spark.sparkContext.broadcast((Table(place_keys), p, Table(word_keys), n))

    def score(source):
        seen, p_of, table, n_of = model.value
        uid = TaskContext.get().partitionId() << 40
        for batch, flat, at in batches(source, "text"):
            size = batch.num_rows
            w = words(flat, at)
            h = word_hashes(LOWER[flat], w)
            place = table.find(h)
            known = place >= 0
            logs = np.where(known, np.log10(n_of[place] + 0.1) if len(n_of) else 0.0, 0.0)
            base = np.bincount(w.owner, logs, size) + np.log10(ends + 0.1)
            common = np.bincount(w.owner[known], minlength=size) + (ends > 0)
            keys, first = framed(flat, at)
            spot = seen.find(keys)
            met = spot >= 0
            sums = np.add.reduceat(np.where(met, p_of[spot] if len(p_of) else 0.0, 0.0), first)
            lists = [*_rare(h[~known], w.owner[~known], size), *_rare(keys[~met], np.repeat(np.arange(size), np.diff(at) + 1)[~met], size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(uid + np.arange(size)), pa.array(np.diff(w.first) + 1), pa.array(common.astype(np.int64)), pa.array(base), pa.array(sums), *lists],
                names=["doc_id", "held_out", "uid", "n_tokens", "known", "base", "score", "rare", "times", "places", "place_times"],
            )
            uid += size

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stored(mapped(rows, score, f"doc_id {kind}, held_out boolean, uid long, n_tokens long, known long, base double, score double, rare array<bigint>, times array<bigint>, places array<bigint>, place_times array<bigint>"))
    model.destroy()
    rare = scored.select("uid", F.inline(F.arrays_zip("rare", "times"))).toDF("uid", "key", "times")
    met = rare.join(tokens, "key", "left").select("uid", "times", F.coalesce("n", F.lit(0)).alias("n"))
    more = met.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    spots = scored.select("uid", F.inline(F.arrays_zip("places", "place_times"))).toDF("uid", "key", "times")
    rest = spots.join(places.select("key", "p"), "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("p")).alias("rest"))
    level = float(np.log10(total + 0.1 * (distinct + 1)))
    return scored.join(more, "uid", "left").join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(level)).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
