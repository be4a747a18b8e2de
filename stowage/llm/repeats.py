"""Suffix-array dedup: bytes that lie in a repeated string of ``LENGTH`` bytes.

Locally the method is a suffix array with longest-previous-factor (LPF) values: the previous and the next smaller text
position in suffix order give the longest earlier match of every suffix, so that ``LPF >= LENGTH`` marks the later
copies and leaves the first (``longest_previous_factor``, ``later_copies``).

Over a corpus the suffix order is dealt out in shards so that equal strings of ``LENGTH`` bytes meet. Every such string
is named by its anchor, the least of the hashes of its ``GRAM``-byte substrings: consecutive starts share an anchor (one
per about ``LENGTH`` / 2 bytes), and equal strings have equal anchors at equal places. A run of starts with its context
(all the bytes of its strings) is one row. Text order is that of document id, row hash and place; the first copy of a
string in that order is the one that a deduplication keeps.

1. Contexts that are equal as a whole are combined before anything is sorted: one of each kind, the first, goes on, with
   the number of copies. All later ones are later copies as a whole. Anchors that occur once are done.
2. The kinds of an anchor with several are brought together with their bytes; a task sorts their suffixes to ``LENGTH``
   bytes by prefix doubling, where suffixes of equal rank lie side by side in text order: the previous smaller position
   of each but the first is its neighbour, so its LPF is at least ``LENGTH``.
3. An anchor with more than ``CROWD`` kinds (the edge of a passage that very many documents share) would be one huge
   shard. It is dealt out further: in blocks of ``BLOCK`` starts by a 128-bit hash of what the strings of a block share,
   equal blocks being combined like contexts, and the rest string by string by a 128-bit hash; the first place of each
   is an aggregate, which is what LPF comes to among equal strings.

Scale: no group is gathered without a bound; counts and first places are combined before the shuffle, stored and joined
back in joins of their own, whose sides are plain exchanges that AQE splits. Tables are deleted as soon as the next one
is written. The text is shuffled once, by row; both joins with it reuse that exchange.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing; a text of any length is read whole;
repeated rows are copies of each other, but rows alike in id and text tie in text order, and all of them count as first;
matches never cross texts; an empty table gives an empty result; other columns are ignored, whatever their names (and
kept by ``without_repeats``). Rows are told apart by 96 bits of hash of id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.bytewords import mix, prefix, span_hash
from stowage.llm.common import batches, forget, letters, mapped, stored

LENGTH = 200
GRAM = 32
CROWD = 512
#: Starts of a crowded context that are dealt out together.
BLOCK = 8


# --- suffix arrays ----------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n = len(data)
    rank, step = data.astype(np.int64) + 1, 1
    while n:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:]
        key = rank * (int(rank.max()) + n + 2) + second
        _, rank = np.unique(key, return_inverse=True)
        rank = rank + 1
        if rank.max() == n or step >= n:
            break
        step *= 2
    return np.argsort(rank, kind="stable") if n else np.zeros(0, np.int64)


def neighbours_lcp(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in suffix order (Kasai)."""
    n, rank, out, h = len(data), np.empty(len(data), np.int64), np.zeros(len(data), np.int64), 0
    rank[order] = np.arange(n)
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and data[i + h] == data[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def _smaller_before(order: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """By text position: the match with the last suffix of the order so far that starts before it (0: there is none)."""
    out, stack = np.zeros(len(order), np.int64), []  # (position, match with the one below), positions rising
    for p, match in zip(order.tolist(), borders.tolist(), strict=True):
        while stack and stack[-1][0] > p:
            match = min(match, stack.pop()[1])
        match = match if stack else 0
        out[p] = match
        stack.append((p, match))
    return out


def longest_previous_factor(data: np.ndarray) -> np.ndarray:
    """LPF[i]: the longest match of data[i:] that starts before i.

    The nearest suffixes on either side in suffix order that start before i (previous and next smaller values) hold it.
    """
    order = suffix_array(data)
    lcp = neighbours_lcp(data, order)
    return np.maximum(_smaller_before(order, lcp), _smaller_before(order[::-1], np.append(lcp[1:], 0)[::-1]) if len(lcp) else lcp)


def later_copies(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which bytes a deduplication that keeps first copies removes."""
    mark = np.zeros(len(data) + 1, np.int64)
    for i in np.flatnonzero(longest_previous_factor(data) >= length):
        mark[i] += 1
        mark[i + length] -= 1
    return np.cumsum(mark[:-1]) > 0


def truncated_classes(flat: np.ndarray, left: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order to ``length`` bytes, ties in text order; their ranks) of all places with enough bytes left."""
    a = flat.astype(np.uint64)
    pad = np.concatenate([a, np.zeros(8, np.uint64)])
    first = pad[: len(a)] << np.uint64(56)
    for k in range(1, 8):
        first |= pad[k : k + len(a)] << np.uint64(56 - 8 * k)
    rank, step = np.unique(first, return_inverse=True)[1].astype(np.int64), 8
    while step < length:
        ahead = min(step, length - step)
        ok = np.flatnonzero(left >= step + ahead)
        pair = rank[ok] << 32 | rank[ok + ahead]
        fresh = np.unique(pair, return_inverse=True)[1]
        rank = np.full(len(flat), -1, np.int64)
        rank[ok] = fresh
        step += ahead
    starts = np.flatnonzero(left >= length)
    order = starts[np.argsort(rank[starts], kind="stable")]
    return order, rank[order]


def previous_factors(order: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(has an earlier copy, has a later copy) by place, from the truncated suffix order.

    Within a class places rise, so the previous smaller value of each but the first is its neighbour, whose match is
    the whole length; across classes a match is shorter.
    """
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    same = rank[1:] == rank[:-1]
    earlier[order[1:][same]] = True
    later[order[:-1][same]] = True
    return earlier, later


# --- anchors -----------------------------------------------------------------------------------------------------


def _grams(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8 bytes and of the GRAM bytes from every place on."""
    a = flat.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    eight = mix(a[:-4] | a[4:] << np.uint64(32))
    sixteen = eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + eight[8:]
    wide = mix(sixteen[:-16] * np.uint64(0xD1342543DE82EF95) + sixteen[16:])
    return eight, wide


def anchors(flat: np.ndarray, at: np.ndarray, length: int = LENGTH):
    """Runs of starts with one anchor: row, first start and start count (in the row), anchor's place after the first start, anchor hash, context hash."""
    if len(flat) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    eight, wide = _grams(flat)
    span = length - GRAM + 1
    v = wide & np.uint64(0xFFFFFFFF00000000) | np.arange(len(wide), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if span > step:
        v = np.minimum(v[: len(v) - (span - step)], v[span - step :])
    place = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(at)
    inside = np.zeros(len(place) + 1, np.int64)
    long = np.flatnonzero(size >= length)
    inside[at[:-1][long]] += 1
    np.add.at(inside, at[1:][long] - length + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    first_of_row = np.zeros(len(place), bool)
    first_of_row[at[:-1][long]] = True
    new |= first_of_row
    s = np.flatnonzero(new)
    row = np.searchsorted(at, s, "right") - 1
    end = np.minimum(np.append(s[1:], len(place)), at[row + 1] - length + 1)  # after the last start
    sums = prefix(eight)
    context = span_hash(sums, s, end - 1 + length - 7)
    return row, s - at[row], end - s, place[s] - s, wide[place[s]], context


#: Where a run of starts is: text order.
PLACE = ["d", "rid", "r2", "s"]


def anchor_table(rows: DataFrame) -> DataFrame:
    def run(source):
        for batch, flat, at in batches(source, "text"):
            row, s, n, off, k, c = anchors(flat, at)
            who = [batch.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*who, pa.array(k.view(np.int64)), pa.array(c.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (s, n, off))], names=["d", "rid", "r2", "k", "c", "s", "n", "off"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows.select("doc_id", "rid", "r2", "text"), run, f"d {kind}, rid long, r2 int, k long, c long, s int, n int, off int")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _contexts(kind: str):
    """The contexts that a row is asked for: k, crowded, single, d, rid, r2, s, bytes, off."""
    names = ["k", "crowd", "single", "d", "rid", "r2", "s", "bytes", "off"]

    def rows(out, d):
        kinds = (pa.int64(), pa.bool_(), pa.bool_(), None, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        columns = [d.take(pa.array([r[3] for r in out], pa.int64())) if t is None else pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(source):
        for batch in source:
            out: list[tuple] = []
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                raw = (column["text"][i].as_py() or "").encode()
                rid, r2 = column["rid"][i].as_py(), column["r2"][i].as_py()
                for w in column["wanted"][i].as_py():
                    out.append((w["k"], w["crowd"], w["single"], i, rid, r2, w["s"], raw[w["s"] : w["s"] + w["n"] - 1 + LENGTH], w["off"]))
                if len(out) > 5_000:
                    yield rows(out, column["doc_id"])
                    out = []
            yield rows(out, column["doc_id"])

    return run, f"k long, crowd boolean, single boolean, d {kind}, rid long, r2 int, s int, bytes binary, off int"


SPANS = "rid long, r2 int, a long, b long, later boolean"


def _sorted_shards(source):
    """SPANS of contexts, from shards that arrive in order of their anchor and then in text order.

    Repeated rows are at the same place, side by side; one of them stands for all, else each would be taken for an
    earlier copy of the next.
    """
    held: list[tuple] = []
    size = 0
    for batch in source:
        ks, single, rid, r2, s = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("k", "single", "rid", "r2", "s"))
        for i, raw in enumerate(batch.column(batch.schema.get_field_index("bytes")).to_pylist()):
            if size > 1 << 20 and ks[i] != held[-1][0]:
                yield _shard(held)
                held, size = [], 0
            if held and (ks[i], rid[i], r2[i], s[i]) == (held[-1][0], *held[-1][2:5]):
                continue
            held.append((ks[i], single[i], rid[i], r2[i], s[i], raw))
            size += len(raw)
    yield _shard(held)


def _shard(held):
    flat = np.frombuffer(b"".join(h[5] for h in held), np.uint8)
    size = np.array([len(h[5]) for h in held], np.int64)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(flat))
    earlier, after = previous_factors(*truncated_classes(flat, left), len(flat))
    found: list[tuple] = []
    for (_, single, rid, r2, s, _), to, n in zip(held, end, size, strict=True):
        own = earlier[to - n : to]
        for flags, later in ((own, True), (own | after[to - n : to], False)):
            if later or single:
                found += [(rid, r2, int(s + x), int(s + y - 1 + LENGTH), later) for x, y in zip(*_runs(flags), strict=True)]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=["rid", "r2", "a", "b", "later"])


def _dealt(kind: str):
    """Crowded contexts in blocks of ``BLOCK`` starts, counted from the anchor.

    b1, b2: block and hash of the bytes that all strings of a whole block share; c: hash of the bytes of the starts that
    are there; d, rid, r2, s: place of the first start; n: starts; single: whether the context is the only one of its
    kind; w1, w2: hashes of the strings.
    """

    def run(source):
        for batch in source:
            for top in range(0, batch.num_rows, 2000):
                part = batch.slice(top, 2000)
                column = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                raw = column["bytes"].to_pylist()
                flat, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
                if not len(flat):
                    continue
                s, off = (column[n].to_numpy(zero_copy_only=False) for n in ("s", "off"))
                n = size - LENGTH + 1
                row = np.repeat(np.arange(len(raw)), n)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = (np.cumsum(size) - size)[row]
                eight, _ = _grams(flat)
                one, two = prefix(eight), prefix(mix(eight ^ np.uint64(0x5851F42D4C957F2D)))
                w1, w2 = (span_hash(sums, begin + inner, begin + inner + LENGTH - 7) for sums in (one, two))
                block = (off[row] - inner) // BLOCK
                edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
                count = np.diff(np.append(edge, len(row)))
                r, q = row[edge], block[edge].astype(np.int64)
                core = begin[edge] + off[r] - q * BLOCK
                b1, b2 = (mix(span_hash(sums, core, core + LENGTH - BLOCK + 1 - 7) + q.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) for sums in (one, two))
                first = begin[edge] + inner[edge]
                c = span_hash(one, first, first + count - 1 + LENGTH - 7)
                lists = [pa.ListArray.from_arrays(pa.array(np.append(edge, len(row)).astype(np.int32)), pa.array(w.view(np.int64))) for w in (w1, w2)]
                who = [column[name].take(pa.array(r)) for name in ("d", "rid", "r2")]
                numbers = [pa.array(x.view(np.int64)) for x in (b1, b2, c)]
                yield pa.RecordBatch.from_arrays([*numbers, *who, pa.array((s[r] + inner[edge]).astype(np.int32)), pa.array(count.astype(np.int32)), column["single"].take(pa.array(r)), *lists], names=["b1", "b2", "c", *PLACE, "n", "single", "w1", "w2"])

    return run, f"b1 long, b2 long, c long, d {kind}, rid long, r2 int, s int, n int, single boolean, w1 array<bigint>, w2 array<bigint>"


def _place(of: str = "") -> Column:
    return F.struct(*(F.col(of + name).alias(name) for name in PLACE))


def _span(later: Column) -> list[Column]:
    return ["rid", "r2", F.col("s").cast("long").alias("a"), (F.col("s") + F.col("n") - 1 + LENGTH).cast("long").alias("b"), later.alias("later")]


def _dealt_spans(contexts: DataFrame, kind: str) -> DataFrame:
    """SPANS: as for whole contexts, later copies of a block are repeated; what is left goes by single starts."""
    dealt = stored(mapped(contexts, *_dealt(kind)))
    kinds = dealt.groupBy("b1", "b2", "c").agg(F.count("*").alias("m"), F.min(F.struct(*PLACE, "n", "single", "w1", "w2")).alias("one"))
    kinds = stored(kinds)
    copied = dealt.join(kinds.where("m > 1").select("b1", "b2", "c", "one"), ["b1", "b2", "c"]).withColumn("later", _place() > _place("one."))
    twice = stored(copied.where("single OR later").select(*_span(F.col("later"))))
    several = kinds.groupBy("b1", "b2").agg(F.count("*").alias("kinds")).where("kinds > 1").select("b1", "b2")
    starts = kinds.join(several, ["b1", "b2"]).select("m", "one.*").select("m", *PLACE, "single", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    starts = stored(starts.select(F.col("w")["w1"].alias("h1"), F.col("w")["w2"].alias("h2"), "d", "rid", "r2", (F.col("s") + F.col("i")).alias("s"), F.lit(1).alias("n"), (F.col("single") & (F.col("m") == 1)).alias("alone")))
    again = starts.groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min(_place()).alias("one")).where("m > 1")
    met = starts.join(again, ["h1", "h2"]).withColumn("later", _place() > F.col("one"))
    counted = stored(met.where("alone OR later").select(*_span(F.col("later"))))
    for table in (dealt, kinds, starts):
        forget(table)
    return twice.unionByName(counted)


def repeated_spans(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """SPANS: stretches of bytes that repeated strings cover (they may overlap); later: by copies that are not the first.

    rows: doc_id, rid, r2, text.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    table = stored(anchor_table(rows))
    seen = table.groupBy("k").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(_place()).alias("one")).where("m > 1")
    seen = stored(seen.select("k", (F.col("lo") == F.col("hi")).alias("alike"), "one"))
    whole = stored(table.join(seen.where("alike"), "k").select(*_span(_place() > F.col("one"))))
    edges = stored(table.join(seen.where("NOT alike").select("k"), "k"))
    for done in (table, seen):
        forget(done)
    kinds = stored(edges.groupBy("k", "c").agg(F.count("*").alias("m"), F.min(F.struct(*PLACE, "n", "off")).alias("one")))
    copied = edges.join(kinds.where("m > 1").select("k", "c", "one"), ["k", "c"])
    twice = stored(copied.select(*_span(_place() > _place("one."))))
    forget(edges)
    crowds = stored(kinds.groupBy("k").agg(F.count("*").alias("size")))
    asked = kinds.join(crowds, "k").select("one.rid", "one.r2", F.struct("k", (F.col("size") > crowd).alias("crowd"), (F.col("m") == 1).alias("single"), F.col("one.s").alias("s"), F.col("one.n").alias("n"), F.col("one.off").alias("off")).alias("w"))
    asked = asked.groupBy("rid", "r2").agg(F.collect_list("w").alias("wanted"))
    fetched = rows.join(asked.hint("shuffle_hash"), ["rid", "r2"]).select("doc_id", "rid", "r2", "text", "wanted")
    contexts = stored(mapped(fetched, *_contexts(kind)))
    for done in (kinds, crowds):
        forget(done)
    shards = contexts.where("NOT crowd").repartition("k").sortWithinPartitions("k", *PLACE)
    sorted_out = stored(mapped(shards, _sorted_shards, SPANS))
    dealt = _dealt_spans(contexts.where("crowd").dropDuplicates(["k", "rid", "r2", "s"]), kind)
    forget(contexts)
    return whole.unionByName(twice).unionByName(sorted_out).unionByName(dealt)


def _cut(raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left without the spans a..b, bytes removed, maximal runs removed)."""
    if not len(a):
        return raw, 0, 0
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    gap = np.concatenate([[True], a[1:] > b[:-1]])
    firsts, lasts = a[gap], b[np.append(np.flatnonzero(gap)[1:] - 1, len(b) - 1)]
    edges = [0, *np.stack([firsts, lasts], axis=1).ravel().tolist(), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)), int((lasts - firsts).sum()), len(firsts)


def _found(spans: pa.Scalar) -> list[np.ndarray]:
    """a, b, later of a row's spans."""
    values = spans.values if spans.is_valid else None
    if values is None:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    return [values.field(j).to_numpy(zero_copy_only=False) for j in range(3)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = letters(F.col(text_col))
    return [F.xxhash64(F.col(id_col), text).alias("rid"), F.hash(F.lit("row"), F.col(id_col), text).alias("r2"), text.alias("text")]


def _spans_by_row(rows: DataFrame, crowd: int) -> DataFrame:
    return repeated_spans(rows, crowd).groupBy("rid", "r2").agg(F.collect_list(F.struct("a", "b", "later")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, without every byte that a repeated string covers.

    And n_later, first_sha256: the bytes that later copies cover, and what is left without these, first copies kept.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *_keyed(docs, id_col, text_col))
    joined = rows.join(_spans_by_row(rows, crowd).hint("shuffle_hash"), ["rid", "r2"], "left").select("doc_id", "text", "spans")

    def run(source):
        for batch in source:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw, (a, b, later) = (text.as_py() or "").encode(), _found(spans)
                kept, removed, runs = _cut(raw, a, b)
                first, gone, _ = _cut(raw, a[later], b[later])
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), gone, hashlib.sha256(first).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in out], t) for j, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_later", "first_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(joined, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_later long, first_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = True, crowd: int = CROWD) -> DataFrame:
    """The documents, all columns, their texts without repeated strings: all copies but the first, or all.

    Of a character that is cut only in part nothing is left; a null text stays null.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *_keyed(docs, id_col, text_col))
    rid, r2, _ = _keyed(docs, id_col, text_col)
    whole = docs.select(F.struct("*").alias("row"), rid, r2)
    spans = _spans_by_row(rows, crowd)
    joined = whole.join(spans.hint("shuffle_hash"), ["rid", "r2"], "left").select("row", "spans")
    docs_columns = docs.columns
    at = docs_columns.index(text_col)

    def run(source):
        for batch in source:
            texts, columns = [], batch.column(0).flatten()
            for text, spans in zip(columns[at], batch.column(1), strict=True):
                said, (a, b, later) = text.as_py(), _found(spans)
                gone = later if keep_first else np.ones(len(a), bool)
                texts.append(_cut(said.encode(), a[gone], b[gone])[0].decode(errors="ignore") if gone.any() else said)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    return mapped(joined, run, docs.schema)
