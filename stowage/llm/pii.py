"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by pattern and check (Luhn, ranges,
digit counts), each kind leftmost and non-overlapping. The field scores whole candidate spans (shape, digit counts,
checks on the span, the word before it): all spans of up to ``MAX_TOKENS`` tokens, and the longest address from each
token on however many it has. A dynamic programme over the tokens chooses boundaries and kinds jointly. It is trained by
maximum likelihood on windows of text in which the base matches are the entities, and on rewritten copies of those
windows (addresses spelt with "at" and "dot", numbers without prefix or with other separators), so that it finds what
the patterns miss.

Scale: one pass over the text, no shuffle; a task holds one slice of a batch. All patterns and the dynamic programme
take time linear in the text and hold a few numbers a token, so a text of any length, of digits alone or without a
blank, is looked at whole.

The sample that the field learns from is bounded by parameters: ``SAMPLE_DOCS`` documents, the first by hash of their
id; of each the first ``DOC_PASSAGES`` passages of under ``PASSAGE`` characters; of these ``MAX_WINDOWS`` windows of at
most ``WINDOW_TOKENS`` tokens. The model is a few hundred numbers. Detection has no such bounds.

Defined results: a null text is empty; offsets are code points, end exclusive; n_email, n_ip, n_card and n_phone count
base spans; an added span never overlaps a base span; of segmentations that score the same the one with fewer spans
counts; without any base match in the sample nothing is added; an empty table gives an empty result; repeated rows are
answered each by itself; other columns are ignored, whatever their names (and kept by ``redact``).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import batches, mapped

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 5
SAMPLE_DOCS = 4000
DOC_PASSAGES = 4
PASSAGE = 2000
MAX_WINDOWS = 600
WINDOW_TOKENS = 60
#: By how much a span's score must exceed that of leaving its tokens out.
MARGIN = 2.0

Span = tuple[int, int, str]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a chain is tried from the first digit of a run alone, and nothing is given back, so that both take linear time
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for chain in _DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end, "ip"
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.start(), m.end(), "phone"


def base_spans(text: str) -> list[Span]:
    found = [*(emails(text) if "@" in text else ()), *ips(text), *cards(text), *(phones(text) if "+" in text else ())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_BLANK = re.compile(r"\s")
#: What makes a token worth a look: a digit, @, or a spelt-out "at".
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]| at (?=\S)", re.IGNORECASE)
_DOT = re.compile(r" dot | ?[(\[]dot[)\]] ?", re.IGNORECASE)
_DOT_INSIDE = re.compile(r"[(\[]dot[)\]]", re.IGNORECASE)
_EDGE = ",.;:!?\"'<>|*&$%#=/\\"
_CUES = {"email": {"mail", "email", "e-mail", "contact", "write"}, "ip": {"ip", "host", "server", "address"}, "card": {"card", "visa", "credit", "iban", "account"}, "phone": {"phone", "tel", "call", "mobile", "fax", "telefon"}}
_ADDRESS = re.compile(r"[\w.%+-]+(?:@| ?[(\[]at[)\]] ?| at )[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[\w-]+)+", re.IGNORECASE)
_HOT = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().-]*")
N_FEATURES = 24


def features(text: str, start: int, end: int, n_tokens: int, before: str) -> np.ndarray:
    """Of the span text[start:end] as a whole; the same for every kind, each kind having its own weights."""
    span, f = text[start:end], np.zeros(N_FEATURES)
    digits = "".join(_DIGIT.findall(span))
    n, number = len(digits), bool(_NUMBER.fullmatch(span))
    f[0] = 1
    f[1] = bool(_ADDRESS.fullmatch(span))
    f[2] = "@" in span
    f[3] = number
    parts = span.split(".")
    f[4] = number and len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    f[5] = number and 12 <= n <= 19 and luhn(digits)
    f[6] = number and 12 <= n <= 19
    f[7] = number and n in (13, 15, 16)
    f[8] = number and 9 <= n <= 11
    f[9] = number and 7 <= n <= 8
    f[10] = n < 7
    f[11] = span[:1] == "+"
    f[12] = number and bool(re.search(r"[0-9][ ).-]+[(]?[0-9]", span)) and "." not in span
    f[13] = span[:1] == "(" or "(" in span and number
    f[14] = any(c.isalpha() for c in span)
    f[15] = n_tokens == 1
    f[16] = n_tokens == 2
    f[17] = n_tokens >= 3
    for i, kind in enumerate(KINDS):
        f[18 + i] = before in _CUES[kind]
    f[22] = number and bool(re.fullmatch(r"(?:[0-9]{4}[ -]?){3,4}[0-9]{0,4}", span))
    f[23] = number and bool(re.fullmatch(r"(?:\+[0-9]{1,3} ?)?[(]?[0-9]{2,4}[)]?[ .-][0-9]{3,4}[ .-][0-9]{3,4}", span))
    return f


def _token_end(text: str, at: int) -> int:
    m = _BLANK.search(text, at)
    return m.start() if m else len(text)


def _token_start(text: str, at: int, floor: int) -> int:
    """The start of the token that ``at`` is in; never below ``floor``, so that no stretch is walked twice."""
    while at > floor and not text[at - 1].isspace():
        at -= 1
    return at


def anchors(text: str) -> Iterator[tuple[int, int]]:
    """Stretches, in order, that hold what may belong to an entity: a token with a digit or @, or a spelt-out address."""
    done = 0
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        if m.group()[0] == " ":  # a word, "at", a host and at least one spelt-out dot
            start, end = _token_start(text, m.start(), done), _token_end(text, m.end())
            if not m.start() or text[m.start() - 1].isspace() or not (_DOT.match(text, end) or _DOT_INSIDE.search(text, m.end(), end)):
                continue
        else:
            start, end = _token_start(text, m.start(), done), _token_end(text, m.end())
            if m.group()[0] in "([":  # the words may stand apart from the mark
                if start == m.start() and start > done and text[start - 1] == " ":
                    start = _token_start(text, start - 1, done)
                if end == m.end() and text[end : end + 1] == " ":
                    end = _token_end(text, end + 1)
        while (dot := _DOT.match(text, end)) and dot.end() < len(text) and not text[dot.end()].isspace():
            end = _token_end(text, dot.end())
        yield start, end
        done = end


def windows(text: str, whole: bool = True) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens around what may belong to an entity, as (start, end) with edge punctuation trimmed.

    Without ``whole`` (for learning) a window may end inside a token; what is cut there is not learned from.
    """
    until, run = -1, []
    for a, b in anchors(text):
        left = max(until, text.rfind("\n", max(0, a - 41), a), a - 40, 0)
        right = min(len(text), b + 40)
        if whole:
            if left > max(until, 0) and not text[left].isspace():
                left = _token_start(text, left, max(until, 0))
            if right < len(text) and right > until:
                right = _token_end(text, right)
        if run and left > until:
            yield run
            run = []
        for m in _TOKEN.finditer(text, max(left, until, 0), right):
            s, e = m.span()
            while s < e and text[s] in _EDGE:
                s += 1
            while e > s and text[e - 1] in _EDGE:
                e -= 1
            if s < e:
                run.append((s, e))
            until = m.end()
        until = max(until, right)
    if run:
        yield run


def segments(text: str, run: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Candidate segments (first token, end token, features) of a window, by first token."""
    hot = [_HOT.search(text, s, e) is not None for s, e in run]
    ends = [e for _, e in run]
    for i in range(len(run)):
        address = 0
        if m := _ADDRESS.match(text, run[i][0], run[-1][1]):
            last = bisect_right(ends, m.end())
            address = next((j for j in range(last, max(i + 1, last - 3), -1) if _ADDRESS.fullmatch(text, run[i][0], ends[j - 1])), 0)
        before, run_hot = None, True
        for j in [*range(i + 1, min(len(run), i + MAX_TOKENS) + 1), *([address] if address > i + MAX_TOKENS else [])]:
            run_hot = run_hot and j <= i + MAX_TOKENS and hot[j - 1]
            if run_hot or j == address:
                if before is None:
                    before = text[run[i - 1][0] : run[i - 1][1]].lower().strip(":") if i else ""
                yield i, j, features(text, run[i][0], run[j - 1][1], j - i, before)


def lattice(text: str, run: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All segments of a window and their features, for learning."""
    found = list(segments(text, run))
    return [(i, j) for i, j, _ in found], np.array([f for *_, f in found]) if found else np.zeros((0, N_FEATURES))


def decode(n: int, scored: Iterator[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The best set of disjoint segments of ``n`` tokens; a token outside scores 0.

    scored: (first token, end token, kind, score), by first token, so that what leads up to it is settled when a
    segment is met; only the best way to every token is held.
    """
    best, start, kinds, scores = np.zeros(n + 1), np.full(n + 1, -1), np.zeros(n + 1, np.int8), np.zeros(n + 1)
    settled = 0

    def settle(until: int, at: int) -> int:
        for t in range(at, until):
            if best[t + 1] <= best[t]:
                best[t + 1], start[t + 1] = best[t], -1
        return until

    for i, j, kind, score in scored:
        settled = settle(max(i, settled), settled)
        if best[i] + score > best[j]:
            best[j], start[j], kinds[j], scores[j] = best[i] + score, i, kind, score
    settle(n, settled)
    found, t = [], n
    while t:
        if start[t] < 0:
            t -= 1
        else:
            found.append((int(start[t]), t, int(kinds[t]), float(scores[t])))
            t = int(start[t])
    return found[::-1]


def _gradient(n: int, found, rows: np.ndarray, gold: list[tuple[int, int]], weights: np.ndarray) -> np.ndarray:
    """Of the log likelihood of one window: what was seen less what is expected."""
    scores = rows @ weights.T
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(found):
        ends.setdefault(j, []).append(k)
        starts.setdefault(i, []).append(k)
    total = np.logaddexp.reduce(scores, axis=1)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, n + 1):
        ahead[t] = np.logaddexp.reduce([ahead[t - 1], *(ahead[found[k][0]] + total[k] for k in ends.get(t, ()))])
    for t in range(n - 1, -1, -1):
        behind[t] = np.logaddexp.reduce([behind[t + 1], *(behind[found[k][1]] + total[k] for k in starts.get(t, ()))])
    first, last = np.array([s[0] for s in found]), np.array([s[1] for s in found])
    expected = np.exp(ahead[first][:, None] + scores + behind[last][:, None] - ahead[n])
    seen = np.zeros_like(expected)
    for k, kind in gold:
        seen[k, kind] = 1
    return (seen - expected).T @ rows


def _rewritten(text: str, kind: str, pick: int) -> str:
    """A spelling of an entity that the base patterns miss."""
    if kind == "email":
        local, _, host = text.partition("@")
        return (f"{local} at {host.replace('.', ' dot ')}", f"{local}(at){host}", f"{local} [at] {host}")[pick % 3]
    if kind == "phone":
        bare = re.sub(r"^\+[0-9]+ ?", "", text)
        return (bare, bare.replace("(", "").replace(")", ""), re.sub(r"[() -]+", ".", bare).strip("."))[pick % 3]
    return text


def train(texts: list[str], epochs: int = 12, rate: float = 0.3, max_windows: int = MAX_WINDOWS, window_tokens: int = WINDOW_TOKENS) -> np.ndarray:
    """kinds x features. texts: passages; their base spans are taken as the entities."""
    cases = []
    for text in texts:
        for turn in range(2):
            made, truth, at = [], [], 0
            for a, b, kind in base_spans(text):
                if a < at:
                    continue
                made.append(text[at:a])
                said = text[a:b] if not turn else _rewritten(text[a:b], kind, zlib.crc32(text[a:b].encode()))
                start = sum(map(len, made))
                made.append(said)
                truth.append((start, start + len(said), kind))
                at = b
            if turn and not truth:
                continue
            whole = "".join(made) + text[at:]
            for run in windows(whole, whole=False):
                found, rows = lattice(whole, run)
                if not found or len(run) > window_tokens:
                    continue
                place = {(run[i][0], run[j - 1][1]): k for k, (i, j) in enumerate(found)}
                gold = [(place[a, b], KINDS.index(kind)) for a, b, kind in truth if (a, b) in place]
                inside = [t for t in truth if run[0][0] <= t[0] and t[1] <= run[-1][1]]
                short = all(found[k][1] - found[k][0] <= MAX_TOKENS for k, _ in gold)  # longer ones have the same features
                if len(gold) == len(inside) and short:
                    cases.append((len(run), found, rows, gold))
    cases = cases[:max_windows]
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -2.0
    if not any(c[3] for c in cases):
        return weights
    squares = np.full_like(weights, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(cases)):
            step = _gradient(*cases[k], weights) - 1e-3 * weights
            squares += step * step
            weights += rate * step / np.sqrt(squares)
    return weights


def added_spans(text: str, base: list[Span], weights: np.ndarray, margin: float = MARGIN) -> list[Span]:
    found, begins = [], [s for s, *_ in base]
    reach = np.maximum.accumulate([e for _, e, _ in base]) if base else []
    for run in windows(text):

        def scored(run=run):
            for i, j, f in segments(text, run):
                values = weights @ f
                kind = int(values.argmax())
                yield i, j, kind, float(values[kind])

        for i, j, kind, score in decode(len(run), scored()):
            a, b = run[i][0], run[j - 1][1]
            before = bisect_left(begins, b)
            if score >= margin and not (before and reach[before - 1] > a):
                found.append((a, b, KINDS[kind]))
    return found


def all_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    more = added_spans(text, base, weights, margin)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "0123456789@"]] = True


def _suspect(flat: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """Which rows hold a digit or @, or might hold a spelt-out address."""
    hits = np.concatenate([[0], np.cumsum(_MARKS[flat])])
    return (hits[at[1:]] > hits[at[:-1]])[:rows]


def _spelt(text: str) -> bool:
    low = text.lower()
    return " dot " in low or "(at)" in low or "[at]" in low


def detect(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256, spans."""

    def run(source):
        for batch, flat, at in batches(source, "text"):
            suspect = _suspect(flat, at, batch.num_rows)
            size = batch.num_rows
            n, base_out, out = {k: [0] * size for k in KINDS}, [""] * size, [""] * size
            for i in range(size):
                text = batch.column(1)[i].as_py()
                if text and (suspect[i] or _spelt(text)):
                    base, every = all_spans(text, weights, margin)
                    for _, _, kind in base:
                        n[kind][i] += 1
                    base_out[i], out[i] = joined(base), joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base_out], pa.string()), pa.array(out, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, max_windows: int = MAX_WINDOWS, doc_passages: int = DOC_PASSAGES, passage: int = PASSAGE) -> np.ndarray:
    """Weights from a bounded sample: the first ``sample_docs`` documents by hash of their id, see the module's notes."""
    key = F.xxhash64(F.lit(7), F.col(id_col))
    last = docs.select(key.alias("k")).orderBy("k").limit(sample_docs).agg(F.max("k")).first()[0]
    if last is None:
        return train([])

    def passages(source):
        for batch, flat, at in batches(source, "text"):
            suspect = _suspect(flat, at, batch.num_rows)
            keys, out_k, out_t = batch.column(0).to_pylist(), [], []
            for i in np.flatnonzero(suspect):
                text, left = batch.column(1)[int(i)].as_py(), doc_passages
                for run in windows(text or "", whole=False):
                    a, b = max(0, run[0][0] - 1), min(len(text), run[-1][1] + 1)
                    if b - a < passage:
                        out_k.append(keys[i])
                        out_t.append(text[a:b])
                        left -= 1
                    if not left:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.int64()), pa.array(out_t, pa.string())], names=["k", "passage"])

    found = mapped(docs.select(key.alias("k"), F.col(text_col).alias("text")).where(F.col("k") <= last), passages, "k long, passage string")
    return train([r["passage"] for r in found.orderBy("k", "passage").limit(max_windows).collect()], max_windows=max_windows)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return detect(docs, fit(docs, id_col, text_col, **options), id_col, text_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with every span (overlapping ones together) replaced by its kind in angle brackets."""
    weights = fit(docs, id_col, text_col, **options)
    names = docs.columns
    at_text = names.index(text_col)

    def clean(text: str) -> str:
        _, spans = all_spans(text, weights)
        out, done = [], 0
        for a, b, kind in spans:
            if a >= done:
                out += [text[done:a], f"<{kind.upper()}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(source):
        for batch, flat, at in batches(source, text_col):
            suspect = _suspect(flat, at, batch.num_rows)
            texts = [clean(t) if t and (suspect[i] or _spelt(t)) else t for i, t in enumerate(batch.column(at_text).to_pylist())]
            columns = list(batch.columns)
            columns[at_text] = pa.array(texts, batch.schema.field(at_text).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(docs, run, docs.schema)
