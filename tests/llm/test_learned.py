"""Operators that retrieve or learn: against brute force where there is one, else by held-out accuracy."""

import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from stowage.session import read_table


def test_licenses(spark, docs, corpus, empty):
    from stowage.llm.licenses import TEMPLATES, Scanner, half_window, recall_bound, scan_licenses, shingles, tokens

    rng = random.Random(4)
    made = []
    for i, (name, text) in enumerate(TEMPLATES.items()):
        words = text.split()
        if len(words) > 30:
            words[10] = "changed"  # containment stays above 0.8
        noisy = "$$ ".join(w.upper() for w in words)
        made += [(1000 + i, f"{corpus[i]}\n{noisy} {corpus[i + 1]}"), (2000 + i, " | ".join(words)), (3000 + i, " ".join(rng.sample(words, len(words))))]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(every).collect()}
    scanner, want = Scanner(TEMPLATES), set()
    for r in every.collect():
        there = set(shingles(tokens(r["text"] or "")[2]))
        want |= {(r["doc_id"], n) for n, s in zip(scanner.names, scanner.sets, strict=True) if len(there & s.keys()) >= 0.8 * len(s)}
    assert want == got and all((1000 + i, n) in got for i, n in enumerate(TEMPLATES))
    assert all(recall_bound(n, half_window(n)) > 0.998 for n in range(1, 20_000))
    assert scan_licenses(empty).count() == 0
    # templates of any length: one word, two, and some thousands of which a tenth is changed
    full = [f"word{i}" for i in range(3000)]
    changed = [w if i % 200 else "other" for i, w in enumerate(full)]
    few = spark.createDataFrame([(1, "The MIT; gnu\nGPL."), (2, f"{corpus[0]} {' '.join(changed)} {corpus[1]}"), (3, "mitten gnu x gpl"), (4, "gnu"), (5, "gpl")], "doc_id long, text string")
    found = scan_licenses(few, {"one": "MIT", "two": "GNU GPL", "long": " ".join(full)}).collect()
    assert sorted((r["doc_id"], r["license"]) for r in found) == [(1, "one"), (1, "two"), (2, "long")] and all(r["containment"] > 0.95 for r in found)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.choice("sid")
        if kind == "s":
            out[at] = rng.choice("abcdé ")
        elif kind == "i":
            out.insert(at, rng.choice("abcdé "))
        else:
            del out[at]
    return "".join(out)


def brute_distance(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance():
    from stowage.llm.decontaminate import distance, passage

    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 70))) for _ in range(2))
        d, start, end = passage(a, b)
        assert d == brute_distance(a, b) == distance(a, b)[0] and brute_distance(a, b[start:end]) == d


def test_decontamination(spark, docs, corpus, data, empty):
    from stowage.llm.decontaminate import contaminated, drop_contaminated, max_edits

    items = read_table(spark, data, "benchmark")
    rng, made, want = random.Random(8), [], set()
    for i, r in enumerate(items.orderBy("item_id").collect()):
        for k, rate in enumerate((0, 0.04, 0.08, 0.1)):
            n = min(int(rate * len(r["text"])), max_edits(len(r["text"])))
            text = f"{corpus[i % 20]} {edited(rng, r['text'], n)}\n{corpus[(i + 3) % 20]}"
            made.append((1000 * (k + 1) + i, text))
            if brute_distance(r["text"], text[max(0, len(corpus[i % 20]) - 20) : len(corpus[i % 20]) + len(r["text"]) + 60]) <= max_edits(len(r["text"])):
                want.add((1000 * (k + 1) + i, r["item_id"]))
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    odd = items.unionByName(spark.createDataFrame([(None, None), (900, ""), (901, "short"), (None, "an item without an id, thirty-odd long")], "item_id long, text string"))
    got = contaminated(every, odd).collect()
    assert len(want) >= 150 and len({(r["doc_id"], r["item_id"]) for r in got} & want) >= 0.97 * len(want)
    by_id, texts = {r["item_id"]: r["text"] for r in items.collect()}, dict(made)
    for r in got:
        assert brute_distance(by_id[r["item_id"]], texts[r["doc_id"]][r["start"] : r["end"]]) == r["distance"] <= max_edits(len(by_id[r["item_id"]]))
    clean = drop_contaminated(every, odd)
    assert clean.count() == every.count() - len({r["doc_id"] for r in got})
    assert contaminated(empty, items).count() == 0 and contaminated(docs, items.where("false")).count() == 0 and drop_contaminated(docs, items.where("false")).count() == docs.count()


def test_decontamination_reaches_a_tenth_of_every_item(spark, corpus):
    from stowage.llm.decontaminate import contaminated

    rng, items, made = random.Random(12), [], []
    for i, m in enumerate([*range(1, 60), 81, 100, 150, 200]):
        mark = "\U0001f600" if i % 3 == 0 else "é" if i % 3 == 1 else ""
        text = "".join(rng.choice("qwxyzjkvbp") for _ in range(m - len(mark))) + mark
        items.append((i, text))
        for n in sorted({0, m // 10}):
            for turn in range(3):  # substitutions spread out, which leave the fewest runs
                out = list(text)
                for j in range(n):
                    out[min(m - 1, (2 * j + 1) * m // (2 * n) + turn)] = "#"
                made.append((1000 * i + 10 * n + turn, f"{corpus[i % 20]} {''.join(out)} {corpus[turn]}", i))
    docs, bench = spark.createDataFrame(made, "doc_id long, text string, item long"), spark.createDataFrame([*items, (99, " \n")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    missed = [(d, i) for d, _, i in made if (d, i) not in got]
    assert [p for p in missed if len(items[p[1]][1]) < 36] == [] and len(missed) <= 0.03 * len(made)
    texts = {d: t for d, t, _ in made}
    for (d, i), r in got.items():
        assert brute_distance(items[i][1], texts[d][r["start"] : r["end"]]) == r["distance"] <= len(items[i][1]) // 10
    assert 99 not in {i for _, i in got}


def test_decontamination_retrieves_at_every_length_and_edit_count(spark, corpus):
    from stowage.llm.decontaminate import contaminated

    rng, items, made, kinds = random.Random(21), [], [], {}
    prose = " ".join(t for t in corpus[:24])
    for m in (40, 90, 200, 450, 1000):
        for turn in range(6):
            at = rng.randrange(max(1, len(prose) - m))
            text = (prose * 2)[at : at + m] if turn % 2 else "".join(rng.choice("qwxyzjkvbp   ") for _ in range(m))
            items.append((len(items) + 0.5, text))
            for n in (0, m // 20, m // 10, m // 10):
                kinds[len(made)] = (m, n)
                made.append((len(made), f"before it 77 {edited(rng, text, n)} after it 78", items[-1][0]))
    docs, bench = spark.createDataFrame(made, "doc_id long, text string, item double"), spark.createDataFrame(items, "item_id double, text string")
    rows = contaminated(docs, bench)
    assert rows.schema["item_id"].dataType.simpleString() == "double"
    got = {(r["doc_id"], r["item_id"]) for r in rows.collect()}
    by = {}
    for d, _, i in made:
        by.setdefault(kinds[d], []).append((d, i) in got)
    assert all(sum(hit) >= 0.9 * len(hit) for hit in by.values()), {k: sum(v) / len(v) for k, v in by.items()}
    assert sum(map(sum, by.values())) >= 0.98 * len(made)
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, part=5000).collect()} == got  # in several passes


def test_decontamination_of_items_under_one_prompt(spark, corpus):
    """Items that share a prompt, at their beginning or end: each is told from the others, and work does not grow with their number."""
    import numpy as np
    import pyarrow as pa
    from stowage.llm.decontaminate import Matcher, contaminated

    rng = random.Random(31)
    words = sorted({w for t in corpus if t for w in t.split() if len(w) < 14})
    said = lambda: " ".join(rng.choice(words) + rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(18, 34)))
    ahead, behind = "Answer the following question about the passage: ", " Which of these answers is the right one, A or B?"
    items = [(n, ahead + said() if n % 2 else said() + behind) for n in range(1200)]
    items.append((5000, items[7][1]))
    made, exact = [], []
    for n in range(0, 240):
        i, text = items[5 * n + 2]
        made.append((n, f"{ahead}{said()}{behind}\n{edited(rng, text, (0, len(text) // 20, len(text) // 10)[n % 3])}\n{ahead}{said()}", i))
        if not n % 3:
            exact.append((n, i))
    docs = spark.createDataFrame(made, "doc_id long, text string, item long")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[pair]["distance"] == 0 for pair in exact)
    assert sum((n, i) in got for n, _, i in made) >= 0.95 * len(made)
    assert all((d, 5000) in got for d, i in got if i == 7)
    of, texts = dict(items), {n: t for n, t, _ in made}
    for (d, i), r in got.items():
        assert brute_distance(of[i], texts[d][r["start"] : r["end"]]) == r["distance"] <= len(of[i]) // 10

    text, lengths = "\n".join(ahead + said() + behind for _ in range(150)).encode(), [len(t) for _, t in items]
    flat, at, tasks = np.frombuffer(text, np.uint8), np.array([0, len(text)]), []
    for n in (300, 1200):
        found = Matcher(pa.array(range(n)), [t for _, t in items[:n]])
        assert found.shared
        tasks.append(sum(map(len, found.starts(flat, at).values())))
    assert tasks[1] <= 2 * tasks[0] and tasks[1] <= 150 * (max(lengths) - min(lengths) + 2 * len(found.plan))  # a start for every length at most


def test_decontamination_of_a_very_long_item(spark, corpus):
    from stowage.llm.decontaminate import contaminated, drop_contaminated

    rng = random.Random(22)
    long = "".join(rng.choice("abcdefghij ") for _ in range(30_000))
    docs = spark.createDataFrame([(1, "x " + edited(rng, long, 900) + " y"), (2, corpus[0])], "doc_id long, text string")
    bench = spark.createDataFrame([("a", long)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()] == [(1, "a")] and drop_contaminated(docs, bench).count() == 1


def test_language(spark, docs, data, empty):
    from stowage.llm.langid import keep_identified, language_id

    d = read_table(spark, data, "documents")
    got = language_id(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language_id(docs).collect()}
    assert odd[36]["lang_pred"] == "und" and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (34, 35, 36, 37)) and odd[38]["lang_pred"] in ("en", "de")
    kept = keep_identified(d)
    assert kept.columns == d.columns and kept.count() >= 0.97 * d.count()
    assert language_id(empty).count() == 0 and language_id(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_network_equals_a_plain_convolution_and_its_gradient():
    """The folded tables against filters slid over the embedded bytes; what training does to them against differences."""
    from stowage.llm import langid as L

    rng = np.random.default_rng(5)
    codes, labels = rng.integers(0, L.N_CLASSES, (12, L.WINDOW)).astype(np.uint8), rng.integers(0, 3, 12)
    shapes = {"e": (L.N_CLASSES, L.DIM), "d": (3 * L.FILTERS, 3), "b": (3,)} | {f"w{w}": (w * L.DIM, L.FILTERS) for w in L.WIDTHS} | {f"c{w}": (L.FILTERS,) for w in L.WIDTHS}
    params = {n: rng.normal(0, 0.4, shape) for n, shape in shapes.items()}

    def plain(p):
        top = [np.array([[max(sum(p["e"][row[i + j]] @ p[f"w{w}"][j * L.DIM : (j + 1) * L.DIM, f] for j in range(w)) + p[f"c{w}"][f] for i in range(L.WINDOW - w + 1)) for f in range(2)] for row in codes[:3]]) for w in L.WIDTHS]
        return np.maximum(np.stack(top), 0)

    got = L.pooled(L.folded(params, ["x", "y", "z"]), codes).reshape(12, 3, L.FILTERS)[:3, :, :2].transpose(1, 0, 2)
    assert np.allclose(got, plain(params), atol=1e-4)

    def loss(p):
        z = np.maximum(np.concatenate([L.spans_of(p, codes, w)[1].max(axis=1) for w in L.WIDTHS], axis=1), 0)
        return -np.log(L.softmax(z @ p["d"] + p["b"])[np.arange(12), labels]).mean()

    grads = L.gradients(params, codes, labels)
    for name, at in [("d", (3, 1)), ("b", (2,)), ("w3", (5, 4)), ("c4", (7,)), *(("e", (c, 2)) for c in np.unique(codes)[:6])]:
        moved = {sign: params | {name: params[name].copy()} for sign in (1, -1)}
        for sign in moved:
            moved[sign][name][at] += sign * 1e-6
        assert np.isclose(grads[name][at], (loss(moved[1]) - loss(moved[-1])) / 2e-6, atol=1e-5), (name, at)


def test_forest_walk_equals_a_plain_one():
    from stowage.llm.quality import grow

    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (400, 5)).astype(np.float32)
    forest = grow(x, (x[:, 0] + x[:, 3] > rng.integers(4, 12, 400)).astype(float), trees=7)
    for row, score in zip(x, forest.score(x), strict=True):
        margin = forest.start
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        assert np.isclose(score, 1 / (1 + np.exp(-margin)))


def test_quality(spark, docs, data, empty):
    from stowage.llm.quality import classify

    d = read_table(spark, "/root/testdata/sf0.01", "documents")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    got = classify(d, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held) and all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert classify(docs, labels.where("false")).where("score <> 0.5").count() == 0
    assert classify(docs, labels).count() == docs.count() and classify(empty, labels).count() == 0
    blind = classify(docs.withColumn("source", F.lit("other")), labels).select("doc_id", "score")
    assert sorted(map(str, blind.collect())) == sorted(map(str, classify(docs, labels).select("doc_id", "score").collect()))


def test_forest_learns_a_rule():
    from stowage.llm.quality import grow

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = grow(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert (grow(x[:10], np.ones(10)).score(x) > 0.9).all() and (grow(x[:0], y[:0]).score(x) == 0.5).all()


def test_pii_field_adds_what_the_patterns_miss():
    from stowage.llm.pii import all_spans, joined, train

    texts = [f"write to user{i}.name@mail{i}.example.com or call +1 ({200 + i}) 555-{1000 + i} from 10.{i}.2.{i} with {v}" for i, v in enumerate(["4111111111111111", "5500000000000004", "4012888888881881", "no card"] * 8)]
    weights = train(texts)
    base, every = all_spans("mail jane.doe at example dot com now, or (212) 555-7788; order 12345 of 2024, room 7", weights)
    assert base == [] and {k for *_, k in every} == {"email", "phone"}
    base, every = all_spans("cards 4111111111111111 5500000000000004 in one row", weights)
    assert base == [] and joined(every) == "card:6:22,card:23:39"
    assert all_spans("plain text of 2023, 15 words and 3.5 percent in 1999", weights)[1] == []
    assert all_spans("call (212) 555-7788", train([]))[1] == []


def test_pii_field_finds_whole_addresses():
    from stowage.llm.pii import all_spans, train

    weights = train([f"write to user{i}.name@mail{i}.example.com or call +1 ({200 + i}) 555-{1000 + i} from 10.{i}.2.{i} with no card" for i in range(32)])
    hosts = ["mail dot example dot com", "mail dot west dot example dot co dot uk", " dot ".join(["part"] * 30), "example dot com"]
    for host in hosts:
        for spelt in (f"jane at {host}", f"jane7 at {host}", f"jane(at){host}", f"jane [at] {host.replace(' dot ', ' [dot] ')}"):
            text = f"please mail {spelt}, she said"
            assert all_spans(text, weights)[1] == [(12, 12 + len(spelt), "email")]
    for gap in range(60):
        text = f"room 7 {('of the house ' * 6)[:gap].strip()} jane at example dot com and so on"
        at = text.index("jane")
        assert (at, at + 23, "email") in all_spans(text, weights)[1]


def test_semi_markov_decoding_is_optimal():
    from itertools import combinations

    from stowage.llm.pii import decode

    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        found = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
        scores = rng.normal(size=(len(found), 2))
        best = max(sum(scores[list(c)].max(axis=1)) for k in range(n + 1) for c in combinations(range(len(found)), k) if all(found[a][1] <= found[b][0] or found[b][1] <= found[a][0] for a, b in combinations(c, 2)))
        got = decode(n, ((i, j, int(s.argmax()), float(s.max())) for (i, j), s in zip(found, scores, strict=True)))
        assert np.isclose(sum(s for *_, s in got), best) and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_semi_markov_gradient_is_that_of_the_likelihood():
    from itertools import combinations

    from stowage.llm.pii import _gradient

    rng = np.random.default_rng(9)
    n, found = 4, [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4)]
    rows, weights, gold = rng.normal(size=(len(found), 3)), rng.normal(size=(2, 3)), [(0, 1), (3, 0)]
    apart = [c for k in range(n + 1) for c in combinations(range(len(found)), k) if all(found[a][1] <= found[b][0] or found[b][1] <= found[a][0] for a, b in combinations(c, 2))]

    def likelihood(w):
        scores = rows @ w.T
        every = sum(np.prod([np.exp(scores[k]).sum() for k in c]) for c in apart)
        return sum(scores[k, kind] for k, kind in gold) - np.log(every)

    got = _gradient(n, found, rows, gold, weights)
    for at in np.ndindex(weights.shape):
        step = np.zeros_like(weights)
        step[at] = 1e-6
        assert np.isclose(got[at], (likelihood(weights + step) - likelihood(weights - step)) / 2e-6, atol=1e-5)


def test_pii_takes_linear_time():
    import time

    from stowage.llm.pii import N_FEATURES, all_spans

    weights = np.random.default_rng(0).normal(size=(4, N_FEATURES))
    for unit in ("7", "a", "1.", "日", "(at)", "a at ", " dot c", "@", "1-", "+1(", "0a", "a@b.c "):
        text = ("1" if unit == "日" else "") + unit * (1_000_000 // len(unit))
        began = time.process_time()
        all_spans(text, weights)
        assert time.process_time() - began < 60, unit
