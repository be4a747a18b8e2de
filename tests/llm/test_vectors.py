"""Vector codes and whitening against plain versions in Python and numpy."""

import hashlib
import math
import random

import numpy as np
import pytest

from stowage.llm import codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row string, part string, entry string, error string, id string, component string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, *["x"] * 7) for i, v, label in rows], SCHEMA).repartition(parts)


def vectors(rng, n, d, distinct=None, step=None):
    pool = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(distinct or n)]
    if step:  # coarse values tie often
        pool = [[round(c / step) * step for c in v] for v in pool]
    return [pool[i % len(pool)] for i in range(n)]


@pytest.fixture
def odd():
    rng = random.Random(3)
    good = vectors(rng, 70, 8, distinct=40)
    rows = [(i, v, (None, 1, 2)[i % 3]) for i, v in enumerate(good)]
    rows += [rows[5], rows[5], (None, good[1], 1), (7, good[9], 2)]  # repeated rows, a null id, an id that is there
    bad = [(900, None, 1), (901, [*good[0][:7], None], 1), (902, [*good[0][:7], float("nan")], 1), (903, [*good[0][:7], float("inf")], None)]
    return rows + bad, rows


# --- codes -----------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    """One part after another, every part with every entry, in every round."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    xs = [[math.floor(float(np.float32(c)) * 1024) for c in v] + [0] * (size - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, xs[k]))[:entries]
    w, found, books = size // 4, [[] for _ in kept], []
    for p in range(4):
        part = [x[p * w : (p + 1) * w] for x in xs]
        book = [part[k] for k in order]
        near = lambda y: min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), j) for j, c in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            at = [near(y)[1] for y in part]
            for j in range(len(book)):
                own = [y for y, a in zip(part, at, strict=True) if a == j]
                if own:
                    book = [*book[:j], [sum(c) // len(own) for c in zip(*own, strict=True)], *book[j + 1 :]]
        for k, y in enumerate(part):
            found[k].append(near(y))
        books += [str(c) for entry in book for c in entry]
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {label: sum(e for e, (_, _, other) in zip(errors, kept, strict=True) if other == label) for _, _, label in kept}
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by_label[label], sha) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=repr)


def coded(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize(("entries", "rounds"), [(256, 4), (5, 4), (1, 2), (16, 0)])
def test_codes_of_odd_rows(spark, odd, entries, rounds):
    assert coded(codes.product_codes(table(spark, odd[0]), entries=entries, rounds=rounds)) == plain_codes(odd[1], entries, rounds)


@pytest.mark.parametrize("seed", range(3))
def test_codes_with_ties(spark, seed):
    """Coarse vectors, so that many parts lie as far from two entries, and entries stand still and move on."""
    rng = random.Random(seed)
    rows = [(i, v, i % 4) for i, v in enumerate(vectors(rng, 400, 8, step=0.25))]
    assert coded(codes.product_codes(table(spark, rows), entries=12)) == plain_codes(rows, 12)


def test_codes_of_one_hot_vector(spark):
    rng = random.Random(9)
    rows = [(i, v, None) for i, v in enumerate(vectors(rng, 200, 4) + [[0.5, 0.25, 0.0, -1.0]] * 100)]
    assert coded(codes.product_codes(table(spark, rows), entries=8)) == plain_codes(rows, 8)


def test_codes_pad_short_vectors(spark):
    rows = [(1, [0.5, 0.25, 1.0], 1), (2, [0.5], 1), (3, [], None), (4, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 1)]
    assert coded(codes.product_codes(table(spark, rows))) == plain_codes(rows)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 2)]):
        assert codes.product_codes(table(spark, rows)).collect() == []


def test_codes_refuse_what_is_not_exact(spark):
    with pytest.raises(ValueError, match="too large"):
        codes.product_codes(table(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)]))
    with pytest.raises(ValueError, match="256"):
        codes.product_codes(table(spark, []), entries=300)


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    x, entries = rng.integers(-(1 << 28), 1 << 28, (50, 4)), rng.integers(-(1 << 28), 1 << 28, (9, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(y, c, strict=True)) for c in entries] for y in x]
    assert codes.exact_scores(x, entries).tolist() == want


def test_a_round_pops_what_drift_has_reached_and_nothing_else(spark):
    """The parts that are not popped keep their nearest entry, and in late rounds these are most."""
    rng = random.Random(4)
    data = [v for centre in range(6) for v in vectors(rng, 100, 4) for v in [[c * 0.2 + centre * 3 for c in v]]]
    xs = np.floor(np.array(data) * 1024).astype(np.int64)
    parts = spark.createDataFrame([(i, 0, -1, x.tolist()) for i, x in enumerate(xs)], "row long, part int, entry int, x array<bigint>")
    lloyd = codes.Lloyd(parts, xs[None, ::101][:, :6].copy())
    popped = []
    for _ in range(6):
        lloyd.round()
        popped.append(lloyd.heaps.runs[-1].count())
        rows = lloyd.heaps.all().collect()
        assert sorted(r["row"] for r in rows) == list(range(len(xs)))  # every part is in one heap
        best, _ = codes.nearest(xs, lloyd.books[0])
        assert all(best[r["row"]] == r["entry"] for r in rows)
        own = [best == j for j in range(6)]
        assert lloyd.counts[0].tolist() == [int(o.sum()) for o in own]
        assert lloyd.sums[0].tolist() == [xs[o].sum(0).tolist() for o in own]
    assert popped[-1] == 0
    runs = lloyd.heaps.runs[0].collect()
    assert all(r["key"] > 0 for r in runs)


# --- whitening -------------------------------------------------------------------


def plain_fit(rows):
    kept = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in kept), default=0)
    xs = [tuple(math.floor(float(np.float32(c)) * 64) + 1000000 for c in v) + (1000000,) * (size - len(v)) for _, v in kept]
    distinct = sorted(set(xs))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in distinct])
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    return kept, xs, n, sums, cov, values[::-1], columns[:, ::-1]


def check_whitening(df, rows, components=16):
    kept, xs, n, sums, cov, values, columns = plain_fit(rows)
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    got = df.collect()
    assert len(got) == k * len(kept)
    far = {}
    for (i, _), x in zip(kept, xs, strict=True):
        far.setdefault((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))), []).append(x)
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(far)
    assert {r["n"] for r in got} == {n}
    assert {r["component"] for r in got} == set(range(1, k + 1))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-9
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    gaps = [min(abs(values[j] - values[o]) for o in range(len(values)) if o != j) for j in range(k)]
    for j in range(k):  # the direction is a matter of sign alone where the value is single
        if gaps[j] > 1e-6 * values[0]:
            own = [r for r in got if r["component"] == j + 1]
            want = {key: [((np.array(x) * n - np.array(sums)) / n) @ columns[:, j] / np.sqrt(values[j]) for x in v][0] for key, v in far.items()}
            pairs = [(r["whitened"], want[r["vec_id"], r["deviation"]]) for r in own]
            sign = np.sign(sum(a * b for a, b in pairs))
            assert np.allclose([a * sign for a, _ in pairs], [b for _, b in pairs], atol=1e-7)


def test_whitening_of_odd_rows(spark, odd):
    check_whitening(whitening.whiten(table(spark, odd[0])), odd[1])


def test_whitening_with_a_falling_spectrum(spark):
    """The random span holds the leading components, so it is not extended."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    scale = 2000.0 * 0.5 ** np.arange(40)
    rows = [(i, v, 0) for i, v in enumerate((rng.standard_normal((300, 40)) * scale @ turn).tolist())]
    df = table(spark, rows)
    base, distinct, size = whitening.prepared(df, "vec_id", "embedding")
    fit, extended = whitening.fitted(distinct, size, components=4, passes=6)
    assert not extended and len(fit.values) == 4
    *_, values, columns = plain_fit(rows)
    assert np.allclose(fit.values, values[:4], rtol=1e-9)
    assert np.allclose(np.abs((fit.components * columns[:, :4]).sum(0)), 1, atol=1e-9)


def test_whitening_extends_over_a_flat_spectrum(spark):
    rng = random.Random(6)
    rows = [(i, v, 0) for i, v in enumerate(vectors(rng, 300, 40))]
    _, distinct, size = whitening.prepared(table(spark, rows), "vec_id", "embedding")
    assert whitening.fitted(distinct, size)[1]
    check_whitening(whitening.whiten(table(spark, rows)), rows)


def test_whitening_leaves_out_what_has_no_variance(spark):
    rng = random.Random(7)
    rows = [(i, [v[0], 0.5, v[1], v[0]], 1) for i, v in enumerate(vectors(rng, 50, 2))]
    check_whitening(whitening.whiten(table(spark, rows)), rows)
    assert whitening.whiten(table(spark, [(i, [0.5, 0.25], 1) for i in range(5)])).collect() == []


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 2)]):
        df = whitening.whiten(table(spark, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.vector_deviations(table(spark, [])).collect() == []


def test_deviations_beyond_64_bits_are_null():
    x, sums = np.array([[1 << 40, 5], [3, 4]]), np.array([7, 9])
    assert whitening.deviations(x, 1 << 10, sums) == [None, (3 * 1024 - 7) ** 2 + (4 * 1024 - 9) ** 2]
