"""The queries of the corpus operators over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.quality import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.ppm import lm_scores

    return lm_scores(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.langid import language_id

    return language_id(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.pii import find_pii

    return find_pii(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.mixing import mix_manifest

    return mix_manifest(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.codes import product_codes

    return product_codes(read_table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.exact import exact_duplicates

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """Five assignments and four moves of the entries, written out; a distance is a sum over the components."""
    steps = [
        r"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x, len(embedding) // 4 AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        "p AS MATERIALIZED (SELECT vec_id, part, x[part * w + 1 : (part + 1) * w] AS x FROM v, range(4) r(part))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))",
    ]
    for k in range(5):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT p.vec_id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN b{k} b USING (part)) GROUP BY vec_id, part)")
        if k < 4:
            steps.append(f"m{k} AS (SELECT part, entry, list(mean ORDER BY i) AS x FROM (SELECT part, entry, i, floor_div AS mean FROM (SELECT part, entry, i, (sum(c)::BIGINT - ((sum(c)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL)) GROUP BY part, entry)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)")
    steps.append("e AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a4 GROUP BY vec_id)")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"


OP12 = r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ 	-]', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
    r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""


def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op13, which SQL can express."""
    from stowage.llm.whitening import vector_deviations

    return vector_deviations(read_table(spark, sf_dir, "embeddings"))


VECTOR_DEVIATIONS = r"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 64)::BIGINT + 1000000) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    d AS (SELECT DISTINCT x FROM v), k AS (SELECT count(*) AS n FROM d),
    s AS (SELECT i, sum(c)::BIGINT AS total FROM (SELECT unnest(x) AS c, generate_subscripts(x, 1) AS i FROM d) GROUP BY i),
    c AS (SELECT vec_id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v)
    SELECT vec_id, n, sum((n * c - total) * (n * c - total))::BIGINT AS deviation FROM c JOIN s USING (i), k GROUP BY vec_id, n"""


def rule_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10, which SQL can express."""
    from stowage.llm.rules import counted

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, "text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


RULE_BASE_COUNTS = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
    places AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS said FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, said) AS n FROM places) WHERE n > 1),
    repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY doc_id),
    c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated ON repeated.doc_id = w.doc_id)
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""


def mix_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op9's sources, which SQL can express."""
    from stowage.llm.mixing import weighed, word_count

    docs = read_table(spark, sf_dir, "documents")
    return weighed(docs.select("source", word_count(docs["text"]).alias("size"))).selectExpr("source", "n AS source_size", "target")


#: The sources that stop at their cap are those with the least size for their weight.
MIX_SOURCE_TARGETS = r"""
    WITH s AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS n FROM documents GROUP BY source),
    r AS (SELECT source, n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY n / w, source) AS k, 1.5::DOUBLE * sum(n) OVER () - 2.0::DOUBLE * (sum(n) OVER (ORDER BY n / w, source ROWS UNBOUNDED PRECEDING) - n) AS share, sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
    f AS (SELECT min(k) AS first, arg_min(share / rest, k) AS rate FROM o WHERE share / rest * w <= 2 * n)
    SELECT source, n::BIGINT AS source_size, (CASE WHEN k >= first THEN rate * w ELSE 2.0 * n END)::DOUBLE AS target FROM o LEFT JOIN f ON true"""


def queries() -> dict[str, Query]:
    return {"op1_license_scan": op1_license_scan, "op2_suffix_dedup": op2_suffix_dedup, "op3_simhash": op3_simhash, "op4_quality_classifier": op4_quality_classifier, "op5_lm_score": op5_lm_score, "op6_language_id": op6_language_id, "op7_pii": op7_pii, "op8_decontamination": op8_decontamination, "op9_mix": op9_mix, "op10_quality_rules": op10_quality_rules, "op11_vector_codes": op11_vector_codes, "op12_exact_dedup": op12_exact_dedup, "op13_whitening": op13_whitening, "vector_deviations": vector_deviations, "rule_base_counts": rule_base_counts, "mix_source_targets": mix_source_targets}


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": _codes_sql(), "op12_exact_dedup": OP12, "vector_deviations": VECTOR_DEVIATIONS, "rule_base_counts": RULE_BASE_COUNTS, "mix_source_targets": MIX_SOURCE_TARGETS}
