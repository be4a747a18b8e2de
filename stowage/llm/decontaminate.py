"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK walk copies a string into a longer one, staying on or leaving a byte by a random bit of (step, byte); strings
a few edits apart walk together again soon, so edit distance becomes Hamming distance. ``SEEDS`` walks with
``SAMPLES`` samples of ``PICK`` walk positions each are the LSH keys of every item and of every window; the items whose
key a window has are retrieved and compared exactly. An item of m code points is matched by a passage within
``max_edits(m)`` edits (a tenth of m). Items come in length classes, and windows are as long as their class. Far into a
long text two walks have drifted apart, so items of over ``REGION`` bytes have walks with their own samples for every
region of that many bytes: some region has no more than its share of the edits.

Where windows stand is decided without loss: by the q-gram lemma a passage within k edits of an item keeps at least
``m - Q + 1 - k * (Q + b - 1)`` of its byte q-grams (b: the most bytes of one of its characters), all of them displaced
by about the passage's start. Windows begin around places that reach
such a count, at the displacements of the q-grams found there; which item they belong to is left to the LSH. A q-gram that over ``CROWD`` places of items hold (a prompt that many
items begin with, a common phrase) is not met with each of them: it is left out of the items' counts, and the counts asked
for are lower by as many. An item that would be left with under half of its count has that half asked for, or else so many
shared q-grams within its length, counted for all such items of a class together; windows then begin at the
displacements that the most q-grams of the class agree on (at least one in ``AGREE`` of the best nearby), which, like the
LSH, can lose a passage. Such a class asks for three common keys of three times as many. Walks are sampled at the steps at which the items of a class
differ, so that a common prompt is not what their keys agree on. Items of which
no q-gram need survive (under some 40 code points, or with wide characters) are cut into one piece more than they may
have edits: one piece survives as it is, and all places of the pieces are compared.

Scale: one pass over the text for every ``PART`` bytes of items, no shuffle, bounded slices. The items of a part, their
q-grams and keys are sent to all tasks (about 32 times ``PART`` bytes at most); windows are embedded in chunks of
``CHUNK`` bytes, and of a walk only the sampled positions are held, so memory does not depend on the items' lengths.

Defined results: one row per document and item, of the least distance, then the first; none for null, empty or clean
texts; items that are null or blank are ignored; equal items match together, and item ids keep their type; a text of any
length is searched whole; repeated rows are answered each by itself; an empty table of documents or items gives an empty
result; other columns are ignored, whatever their names (and kept by ``drop_contaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.bytewords import mix
from stowage.llm.common import batches, mapped

RATE = 0.1
Q = 8
MIN_ITEM = 16
SEEDS = 4
SAMPLES = 24
PICK = 4
STRETCH = 1.25
REGION = 160
#: Bytes of items that are looked for in one pass over the text, about.
PART = 4 << 20
#: Bytes of windows that are embedded together.
CHUNK = 8 << 20
#: Steps of a walk whose bits are kept; those of later steps are worked out when they are met.
STEPS = 4096
#: Bytes of text looked at together: the walks cost the same for few windows as for many.
SLICE = 3 << 20
#: A q-gram that more places of items hold is counted for all items of a length class together.
CROWD = 32
#: Steps of a walk at which two items of a class have the same byte more often tell them apart too badly to be sampled.
ALIKE = 0.125
#: Of shared q-grams windows begin at displacements that at least one in so many of those at the best one nearby agree on.
AGREE = 8
#: Bytes of text whose q-grams are counted together, about.
STRIDE = 1 << 19


def max_edits(m: int, rate: float = RATE) -> int:
    return max(0, min(int(rate * m), m - 1))


def octets(flat: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from every place on (that many fewer places) as a number."""
    n = len(flat) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a = flat.astype(np.uint64)
    a = a[:-1] | a[1:] << np.uint64(8)
    a = a[:-2] | a[2:] << np.uint64(16)
    return a[:-4] | a[4:] << np.uint64(32)


def grams(flat: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from every place on."""
    return mix(octets(flat))


def distance(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of the text, and where the first such stretch ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def passage(pattern: str, text: str, most: float = float("inf")) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of the text nearest to the pattern; where it starts is told up to ``most`` edits."""
    d, end = distance(pattern, text)
    if d > most:
        return d, 0, end
    back, length = distance(pattern[::-1], text[:end][::-1])
    return d, end - length if back == d else 0, end


def walk_bits(seed: int, first: int, steps: int) -> np.ndarray:
    """steps x 256: whether a walk goes on after a byte, from step ``first`` on."""
    key = (np.arange(first, first + steps, dtype=np.uint64)[:, None] * np.uint64(256) + np.arange(256, dtype=np.uint64)) * np.uint64(SEEDS) + np.uint64(seed)
    return (mix(key ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(63)).astype(np.uint8)


_walks: dict[int, np.ndarray] = {}


def walk(seed: int, step: int) -> np.ndarray:
    if step >= STEPS:
        return walk_bits(seed, step, 1)[0]
    if seed not in _walks:
        _walks[seed] = walk_bits(seed, 0, STEPS)
    return _walks[seed][step]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (count[i] of them), end to end."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def padded(raw: list[np.ndarray], own: np.ndarray, longest: int) -> np.ndarray:
    """Items as rows of ``longest`` bytes."""
    out = np.zeros((len(own), longest), np.uint8)
    for row, k in enumerate(own):
        out[row, : len(raw[k])] = raw[k]
    return out


class Matcher:
    def __init__(self, ids: pa.Array, texts: list[str], rate: float = RATE, seed: int = 17):
        self.ids, self.texts = ids, list(dict.fromkeys(texts))
        spot = {t: k for k, t in enumerate(self.texts)}
        self.own: list[list[int]] = [[] for _ in spot]  # places in ids of the items of one text
        for n, t in enumerate(texts):
            self.own[spot[t]].append(n)
        self.edits = [max_edits(len(t), rate) for t in self.texts]
        raw = [np.frombuffer(t.encode(), np.uint8) for t in self.texts]
        self.length = np.array([len(b) for b in raw], np.int64)
        widest = [max(len(c.encode()) for c in t) for t in self.texts]
        kept = np.array([len(b) - Q + 1 - k * (Q + w - 1) for b, k, w in zip(raw, self.edits, widest, strict=True)])
        self.need, short = np.maximum(kept, 1), kept < 1
        self.pieces = self.cut(np.flatnonzero(short))
        # a bucket of displacements holds every passage's kept q-grams, as buckets overlap by half
        self.reach = np.array([4 * k + 1 for k in self.edits], np.int64)
        self.width = 4 * self.reach
        long = np.flatnonzero(~short)
        sizes = np.maximum(self.length[long] - Q + 1, 0)
        gram = np.concatenate([np.zeros(0, np.uint64), *(grams(raw[k]) for k in long)])
        order = np.argsort(gram, kind="stable")
        self.item = np.repeat(long, sizes)[order].astype(np.int32)
        self.offset = spread(np.zeros(len(long), np.int64), sizes)[order].astype(np.int32)
        self.known, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.first, self.count = self.first.astype(np.int32), self.count.astype(np.int32)
        self.half = -(-self.need // 2)
        crowded = np.repeat(self.count > CROWD, self.count)
        self.least = self.need - np.bincount(self.item[crowded], minlength=len(self.texts))
        prompted = self.least < self.half
        self.least = np.maximum(self.least, self.half)
        self.overlap = int((self.length + 4 * np.array(self.edits, np.int64)).max(initial=0))
        self.stride = max(STRIDE, 2 * self.overlap)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True
        rng = np.random.default_rng(seed)
        self.classes = np.floor(np.log(np.maximum(self.length, MIN_ITEM) / MIN_ITEM) / np.log(STRETCH) + 1e-9).astype(int)
        self.plan: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # walks of a class: seed, first byte, samples
        self.keys = {}
        self.shared = self.sharing(crowded & prompted[self.item], np.repeat(np.arange(len(self.known)), self.count))
        for c in np.unique(self.classes[~short]):
            own = np.flatnonzero((self.classes == c) & ~short)
            least, longest = int(self.length[own].min()), int(self.length[own].max())
            regions = [(0, least)] if least <= REGION + REGION // 4 else [(o, REGION) for o in range(0, least - REGION // 2, REGION)]
            regions = [r for r in regions for _ in range(max(2, -(-SEEDS // len(regions))))]
            walks = [(n % SEEDS, first, self.telling(raw, own, n % SEEDS, first, max(8, 2 * size))) for n, (first, size) in enumerate(regions)]
            telling = [w for w in walks if len(w[2])] or [(n % SEEDS, first, np.arange(max(8, 2 * size))) for n, (first, size) in enumerate(regions)]
            telling = [telling[n % len(telling)] for n in range(len(walks))]
            many = SAMPLES * self.wanted(c)
            self.plan[c] = [(seed, first, steps[rng.integers(0, len(steps), (many, PICK))]) for seed, first, steps in telling]
            step, key = self.step(c, longest), []
            for a in range(0, len(own), step):
                key.append(self.keyed(padded(raw, own[a : a + step], longest), c))
            flat_keys, owners = np.concatenate(key).ravel(), np.repeat(own, key[0].shape[1])
            at = np.argsort(flat_keys, kind="stable")
            self.keys[c] = flat_keys[at], owners[at].astype(np.int32), longest

    def sharing(self, picked: np.ndarray, gram: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int, int]]:
        """Length class -> shared q-grams of its items, their offsets (first, count, flat), how many of them are asked for, within how many bytes, edits."""
        out = {}
        item, gram, offset = self.item[picked], gram[picked], self.offset[picked].astype(np.int64)
        for c in np.unique(self.classes[item]):
            own = self.classes[item] == c
            most = int(offset[own].max()) + 1
            pairs = np.unique(gram[own] * most + offset[own])
            which, first, count = np.unique(pairs // most, return_index=True, return_counts=True)
            members = np.unique(item[own])
            k = max(self.edits[i] for i in members)
            out[int(c)] = which, first, count, pairs % most, int((self.need[members] // 2 + 1).min()), int(self.length[members].max()) + 4 * k, k
        return out

    def telling(self, raw: list[np.ndarray], own: np.ndarray, seed: int, first: int, steps: int) -> np.ndarray:
        """The steps of a walk that tell the items of a class apart: all of them in small classes, none where under a tenth do."""
        if len(own) < CROWD:
            return np.arange(steps)
        longest, tally = int(self.length[own].max()), np.zeros((steps, 256))
        for a in range(0, len(own), per := max(1, CHUNK // longest)):
            rows = padded(raw, own[a : a + per], longest)
            place, every = np.full(len(rows), first, np.int64), np.arange(len(rows))
            for step in range(steps):
                said = rows[every, np.minimum(place, longest - 1)]
                said[place >= longest] = 0
                tally[step] += np.bincount(said, minlength=256)
                place += walk(seed, step)[said]
        differ = np.flatnonzero(((tally[:, 1:] / len(own)) ** 2).sum(axis=1) < ALIKE)
        return differ if 10 * len(differ) >= steps else differ[:0]

    def wanted(self, c: int) -> int:
        """How many keys a window must have in common with an item: of a class whose items share much, three of three times as many."""
        return 3 if c in self.shared else 1

    def step(self, c: int, longest: int) -> int:
        """How many windows of a class are embedded together."""
        return max(1, CHUNK // max(longest, 8 * sum(len(samples) for *_, samples in self.plan[c])))

    def cut(self, items: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By bytes looked at (Q at most): what they may be, where each value's pieces begin and end, items, offsets in code points."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in items:
            text, n = self.texts[k], self.edits[k] + 1
            for i in range(n):
                offset = i * len(text) // n
                piece = text[offset : (i + 1) * len(text) // n].encode()[:Q]
                found.setdefault(len(piece), []).append((int.from_bytes(piece, "little"), int(k), offset))
        out = {}
        for size, pieces in found.items():
            pieces.sort()
            value, first, count = np.unique(np.array([v for v, *_ in pieces], np.uint64), return_index=True, return_counts=True)
            out[size] = value, first, first + count, np.array([k for _, k, _ in pieces]), np.array([o for *_, o in pieces])
        return out

    def near(self, flat: np.ndarray, at: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Row -> item -> (byte in the row, offset in the item) of the pieces that are there."""
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        if not self.pieces or not len(flat):
            return out
        every = octets(np.concatenate([flat, np.zeros(Q - 1, np.uint8)]))
        for size, (value, first, end, item, offset) in self.pieces.items():
            own = every & np.uint64((1 << (8 * size)) - 1)
            there = np.zeros(1 << 16, bool)
            there[value & np.uint64(0xFFFF)] = True
            spot = np.flatnonzero(there[own & np.uint64(0xFFFF)])
            k = np.minimum(np.searchsorted(value, own[spot]), len(value) - 1)
            same = value[k] == own[spot]
            spot, k = spot[same], k[same]
            row = np.searchsorted(at, spot, "right") - 1
            whole = spot + size <= at[row + 1]
            for s, j, r in zip(spot[whole], k[whole], row[whole], strict=True):
                for n in range(first[j], end[j]):
                    out.setdefault(int(r), {}).setdefault(int(item[n]), []).append((int(s - at[r]), int(offset[n])))
        return out

    def keyed(self, windows: np.ndarray, c: int) -> np.ndarray:
        """windows x (walks * samples) keys, with the walks and samples of their length class."""
        rows, last, plan = np.arange(len(windows)), windows.shape[1] - 1, self.plan[c]
        keys, done = np.zeros((len(windows), sum(len(samples) for *_, samples in plan)), np.uint64), 0
        for seed, first, samples in plan:
            wanted, which = np.unique(samples, return_inverse=True)
            seen, spots = np.zeros((len(wanted), len(windows)), np.uint8), dict(zip(wanted.tolist(), range(len(wanted)), strict=True))
            place = np.full(len(windows), first, np.int64)
            for step in range(int(wanted[-1]) + 1):
                said = windows[rows, np.minimum(place, last)]
                said[place > last] = 0
                if step in spots:
                    seen[spots[step]] = said
                place += walk(seed, step)[said]
            for s, picked in enumerate(which.reshape(samples.shape), done):
                value = np.full(len(windows), s, np.uint64)
                for p in picked:
                    value = value << np.uint64(8) | seen[p].astype(np.uint64)
                keys[:, s] = mix(value)
            done += len(samples)
        return keys

    def starts(self, flat: np.ndarray, at: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """Length class -> (row, start in the row) of the windows to embed."""
        h = grams(flat)
        spot = np.flatnonzero(self.filter[h >> np.uint64(44)])
        k = np.searchsorted(self.known, h[spot])
        k[k == len(self.known)] = 0
        same = self.known[k] == h[spot] if len(self.known) else np.zeros(len(k), bool)
        spot, k = spot[same], k[same]
        row = np.searchsorted(at, spot, "right") - 1
        whole = spot + Q <= at[row + 1]
        spot, k, row = spot[whole], k[whole], row[whole]
        found: dict[int, set[tuple[int, int]]] = {}
        rare = self.count[k] <= CROWD
        for a in range(0, len(flat), self.stride):
            part = slice(*np.searchsorted(spot, [a, a + self.stride + self.overlap]))
            own = rare[part]
            self.counted(spot[part][own], k[part][own], row[part][own], at, found)
            if self.shared:
                self.agreed(spot[part][~own], k[part][~own], row[part][~own], at, found)
        return found

    def counted(self, spot: np.ndarray, k: np.ndarray, row: np.ndarray, at: np.ndarray, found: dict[int, set[tuple[int, int]]]) -> None:
        """Windows where an item has enough of its own q-grams."""
        n = self.count[k].astype(np.int64)
        if not len(n):
            return
        which = spread(self.first[k].astype(np.int64), n)
        item, row = self.item[which].astype(np.int64), np.repeat(row, n)
        shift = np.repeat(spot, n) - self.offset[which]
        low = 2 * int(self.length.max())
        span = int(at[-1]) + 2 * low + 8
        for half in (0, 1):
            width = self.width[item]
            bucket = (shift + low + half * width // 2) // width
            key = (row * len(self.texts) + item) * span + bucket
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.diff(key[order], prepend=-1))
            size = np.diff(np.append(edge, len(order)))
            for e in np.flatnonzero(size >= self.least[item[order[edge]]]):
                own = order[edge[e] : edge[e] + size[e]]
                r, i = int(row[own[0]]), int(item[own[0]])
                if len(np.unique(self.offset[which[own]])) < self.least[i]:
                    continue
                a, b = int(at[r]), int(at[r + 1])
                begin = np.unique(np.clip(shift[own], a, b - 1)) - a
                found.setdefault(int(self.classes[i]), set()).update((r, x) for x in begin.tolist())

    def agreed(self, spot: np.ndarray, k: np.ndarray, row: np.ndarray, at: np.ndarray, found: dict[int, set[tuple[int, int]]]) -> None:
        """Windows where a class has enough of the q-grams that its items share."""
        for c, (gram, first, count, offsets, least, span, edits) in self.shared.items():
            which = np.minimum(np.searchsorted(gram, k), len(gram) - 1)
            hit = np.flatnonzero(gram[which] == k)
            if len(hit) < least:
                continue
            place = spot[hit]
            dense = np.flatnonzero(place[least - 1 :] - place[: len(hit) - least + 1] <= span)
            cover = np.cumsum(np.bincount(dense, minlength=len(hit) + 1) - np.bincount(dense + least, minlength=len(hit) + 1)[: len(hit) + 1])[: len(hit)]
            hit = hit[cover > 0]
            n = count[which[hit]]
            begin = np.repeat(spot[hit], n) - offsets[spread(first[which[hit]], n)]
            begin = np.clip(begin, np.repeat(at[row[hit]], n), np.repeat(at[row[hit] + 1] - 1, n))
            begin, support = np.unique(begin, return_counts=True)
            if not len(begin):
                continue
            until, reach = np.concatenate([[0], np.cumsum(support)]), 4 * edits
            around = until[np.searchsorted(begin, begin + reach, "right")] - until[np.searchsorted(begin, begin - reach)]
            begin, support = begin[around >= least], support[around >= least]
            if not len(begin):
                continue
            cell, inverse = np.unique(begin // (reach + 1), return_inverse=True)
            best = np.zeros(len(cell), np.int64)
            np.maximum.at(best, inverse, support)
            beside, next_to = best.copy(), np.diff(cell) == 1
            beside[1:][next_to] = np.maximum(beside[1:], best[:-1])[next_to]
            beside[:-1][next_to] = np.maximum(beside[:-1], best[1:])[next_to]
            begin = begin[AGREE * support >= beside[inverse]]
            own = np.searchsorted(at, begin, "right") - 1
            found.setdefault(c, set()).update(zip(own.tolist(), (begin - at[own]).tolist(), strict=True))

    def retrieved(self, flat: np.ndarray, at: np.ndarray) -> dict[int, dict[int, set[int]]]:
        """Row -> item -> starts of the windows that share a key with it."""
        pairs: dict[int, dict[int, set[int]]] = {}
        for c, wanted in self.starts(flat, at).items():
            known, owner, longest = self.keys[c]
            windows, step = sorted(wanted), self.step(c, longest)
            for a in range(0, len(windows), step):
                part = windows[a : a + step]
                filled = np.zeros((len(part), longest), np.uint8)
                for n, (r, s) in enumerate(part):
                    own = flat[at[r] + s : min(at[r + 1], at[r] + s + longest)]
                    filled[n, : len(own)] = own
                keys = self.keyed(filled, c)
                left, right = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
                n, key = np.nonzero(right > left)
                left, count = left[n, key], (right - left)[n, key]
                same, times = np.unique(np.repeat(n, count) * len(self.texts) + owner[spread(left, count)], return_counts=True)
                for pair in same[times >= self.wanted(c)].tolist():
                    r, start = part[pair // len(self.texts)]
                    pairs.setdefault(r, {}).setdefault(pair % len(self.texts), set()).add(start)
        return pairs

    def hits(self, flat: np.ndarray, at: np.ndarray, text_of) -> dict[int, list[tuple[int, int, int, int]]]:
        """Row -> (item, distance, start, end), in code points."""
        pairs = self.retrieved(flat, at)
        out = {}
        for r, items in sorted(pairs.items()):
            text = text_of(r)
            points = np.cumsum(flat[at[r] : at[r + 1]] & 0xC0 != 0x80) - 1
            for k, spots in sorted(items.items()):
                m, e, best, until = len(self.texts[k]), self.edits[k], None, -1
                for s in sorted(spots):
                    point = int(points[s])
                    if point < until:
                        continue
                    a = max(0, point - 2 * e - 8)
                    stretch = text[a : point + m + 4 * e + 64]
                    until = point + 2 * e + 64  # a passage from before there lies in the stretch
                    d, x, y = passage(self.texts[k], stretch, e)
                    if d <= e and (best is None or d < best[0]):
                        best = (d, a + x, a + y)
                        if not d:
                            break
                if best:
                    out.setdefault(r, []).append((k, *best))
        for r, items in self.near(flat, at).items():
            text = text_of(r)
            points = np.cumsum(flat[at[r] : at[r + 1]] & 0xC0 != 0x80) - 1
            for k, spots in items.items():
                m, e, best = len(self.texts[k]), self.edits[k], None
                for begin in sorted({int(points[s]) - o for s, o in spots}):
                    a = max(0, begin - e)
                    stretch = text[a : max(0, begin + m + e)]
                    d, x, y = passage(self.texts[k], stretch, e) if e else (0 if stretch == self.texts[k] else m, 0, m)
                    if d <= e and (best is None or d < best[0]):
                        best = (d, a + x, a + y)
                        if not d:
                            break
                if best:
                    out.setdefault(r, []).append((k, *best))
        return {r: sorted(own) for r, own in sorted(out.items())}


def matchers(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", rate: float = RATE, part: int = PART) -> Iterator[Matcher]:
    """One for about every ``part`` bytes of items, dealt out by hash."""
    usable = benchmark.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    parts = -(-(usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part)
    for n in range(parts):
        own = usable.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == n).toArrow()
        ids, texts = own.column(0).combine_chunks(), own.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], repr(ids[i])))  # noqa: B023
        if order:
            yield Matcher(ids.take(pa.array(order)), [texts[i] for i in order], rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, part: int = PART) -> DataFrame:
    """doc_id, item_id, distance, similarity, start, end (code points)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, similarity double, start long, end long"

    def searched(found: Matcher) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def run(source):
            own = shared.value
            size = {n: len(t) for t, places in zip(own.texts, own.own, strict=True) for n in places}
            for batch, flat, at in batches(source, "text", SLICE):
                hits = [(r, n, *h[1:]) for r, all_ in own.hits(flat, at, lambda r, column=batch.column(1): column[r].as_py()).items() for h in all_ for n in own.own[h[0]]]
                ids, items = (c.take(pa.array([h[j] for h in hits], pa.int64())) for j, c in ((0, batch.column(0)), (1, own.ids)))
                near = [1 - d / size[k] for _, k, d, _, _ in hits]
                yield pa.RecordBatch.from_arrays([ids, items, pa.array([h[2] for h in hits], pa.int32()), pa.array(near, pa.float64()), *(pa.array([h[j] for h in hits], pa.int64()) for j in (3, 4))], names=["doc_id", "item_id", "distance", "similarity", "start", "end"])

        return mapped(rows, run, schema)

    every = [searched(found) for found in matchers(benchmark, item_col, item_text_col, rate, part)]
    return reduce(DataFrame.unionByName, every) if every else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, part: int = PART) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    place = docs.columns.index(text_col)

    def kept(rows: DataFrame, found: Matcher) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def run(source):
            for batch, flat, at in batches(source, text_col, SLICE):
                clean = np.ones(batch.num_rows, bool)
                clean[list(shared.value.hits(flat, at, lambda r, column=batch.column(place): column[r].as_py()))] = False
                yield batch.filter(pa.array(clean))

        return mapped(rows, run, rows.schema)

    return reduce(kept, matchers(benchmark, item_col, item_text_col, rate, part), docs)
