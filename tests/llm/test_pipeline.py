"""The pipeline and the registered queries on the smallest tables."""

import re

from pyspark.sql import functions as F

from stowage.session import read_table
from test_exact import WORD, brute_base, brute_components, brute_fingerprint


def test_stages(spark, data):
    import corpus_pipeline as P
    from stowage.llm.decontaminate import contaminated
    from stowage.llm.langid import language_id

    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "mixing"]
    docs = read_table(spark, data, "documents")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], data))
    assert all(df.columns == docs.columns for df in out[:5])
    texts = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in out[:5]]
    told = {r["doc_id"] for r in language_id(docs).where("lang_pred <> 'und' AND score >= 0.3").collect()}
    assert texts[1].keys() == told
    ids = sorted(texts[1])
    roots = brute_components([brute_fingerprint(texts[1][i]) for i in ids])
    assert texts[2].keys() == {min(i for i, r in zip(ids, roots, strict=True) if r == root) for root in set(roots)}
    held = {r["doc_id"] for r in contaminated(out[2], read_table(spark, data, "benchmark")).collect()}
    assert texts[3].keys() == texts[2].keys() - held and all(texts[3][i] == texts[0][i] for i in texts[3])
    assert texts[4].keys() == texts[3].keys()
    for i, t in texts[4].items():
        assert not brute_base(t) and (t == texts[3][i] or brute_base(texts[3][i]) or "<" in t)
    assert out[4].where(F.col("n_chars") != F.length("text")).count() == 0
    last = {r["doc_id"]: r for r in out[5].collect()}
    assert sorted(map(str, P.run(spark, data).collect())) == sorted(map(str, last.values()))
    assert last.keys() <= texts[4].keys() and all(r["taken"] > 0 and r["size"] == len(WORD.findall(texts[4][i])) for i, r in last.items())


def test_stages_on_odd_rows_and_names(spark, data, docs, empty):
    """Nulls, repeated rows, an empty table and clashing names go through every stage, each on its own."""
    import corpus_pipeline as P

    names = ["__id", "__h", "row", "one", "two", "n", "at", "item", "part", "key", "sid", "block", "start"]
    odd = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names) if n not in docs.columns))
    size = odd.count()
    for name, stage in P.STAGES[:4]:
        got = stage(spark, odd, data)
        assert got.columns == odd.columns and got.count() <= size, name
        assert stage(spark, odd.where("false"), data).count() == 0, name
    kept = P.near_duplicates(spark, odd, data)
    roots = brute_components([brute_fingerprint(r["text"]) for r in odd.collect()])
    assert kept.count() == len(set(roots))
    told = {r["doc_id"] for r in P.language_id(spark, odd, data).collect()}
    assert not told & {34, 35, 36, 37} and 0 in told
    clean = {(r["doc_id"], r["text"]) for r in P.pii(spark, odd, data).collect()}
    assert len(clean) <= size and any(t and "<EMAIL>" in t for _, t in clean) and any(t is None for _, t in clean)
    assert P.decontamination(spark, odd, data).count() == size  # no benchmark item in there
    taken = P.mixing(spark, odd, data).collect()
    assert all(0 < r["taken"] <= 2 * r["size"] for r in taken) and P.mixing(spark, empty, data).count() == 0


def test_registry(spark, data):
    from stowage.llm import registry

    names = [n for n in registry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and registry.oracle_sql().keys() <= registry.queries().keys()


def test_queries_with_sql(spark, data):
    import duckdb

    from stowage.llm import registry

    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"create view {table} as select * from '{data}/{table}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, data), duck.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in them), key=str) for them in (got.select(*columns).collect(), want.select(*columns).fetchall())]
        assert rows[0] == rows[1], name
