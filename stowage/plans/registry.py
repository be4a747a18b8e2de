"""The library's queries over a folder of tables, each with the SQL it must agree with."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import constants as C
from stowage.functions import expressions as X
from stowage.operators import catalog as K
from stowage.operators import concepts, dedup, incremental
from stowage.operators import taxonomy as T
from stowage.operators.deltalog import DeltaLog, Table
from stowage.plans import views as V
from stowage.plans.classifiers import StubClassifier
from stowage.session import read_table, shared_dir, stored
from stowage.streaming import failures

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _stem(path: Column) -> Column:
    return X.path_stem(path)


_STEM = "regexp_replace(regexp_extract(source_path, '[^/]+$'), '\\.[^.]+$', '')"
_EXT = "lower(regexp_extract(source_path, '[^.]+$'))"

# --- digests and duplicates -----------------------------------------------------


@query(f"WITH {V.DIGESTS} SELECT doc_id, digest FROM digests")
def digest_documents(spark, sf_dir):
    return V.digests(spark, sf_dir).select("doc_id", "digest")


_RANKED = f"{V.DIGESTS}, ranked AS (SELECT *, CASE WHEN source_path = min(source_path) OVER (PARTITION BY digest) THEN 'copied' ELSE 'duplicate' END AS status FROM digests)"


@query(f"WITH {_RANKED} SELECT source_path, status FROM ranked")
def dedup_first(spark, sf_dir):
    return dedup.mark_duplicates(V.digests(spark, sf_dir)).select("source_path", "status")


@query(f"WITH {_RANKED} SELECT digest, min(source_path) AS original_path, coalesce(string_agg(source_path, '|' ORDER BY source_path) FILTER (status = 'duplicate'), '') AS duplicates FROM ranked GROUP BY digest")
def dedup_history(spark, sf_dir):
    marked = dedup.mark_duplicates(V.digests(spark, sf_dir))
    paths = F.array_sort(F.collect_list(F.when(F.col("status") == "duplicate", F.col("source_path"))))
    return marked.groupBy("digest").agg(F.min("source_path").alias("original_path"), F.array_join(paths, "|").alias("duplicates"))


@query(f"WITH {_RANKED} SELECT lang, count(*) AS total, count(*) FILTER (status = 'copied') AS copied, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors FROM ranked GROUP BY lang")
def run_status_counts(spark, sf_dir):
    return dedup.run_stats(dedup.mark_duplicates(V.digests(spark, sf_dir)), "lang")


@query(
    f"""WITH {V.DIGESTS}, firsts AS (SELECT *, doc_id % 4 <> 0 AS ok, min(CASE WHEN doc_id % 4 <> 0 THEN source_path END) OVER (PARTITION BY digest) AS first FROM digests)
    SELECT source_path, CASE WHEN first IS NULL OR source_path < first THEN 'error' WHEN source_path = first THEN 'copied' ELSE 'duplicate' END AS status FROM firsts"""
)
def dedup_with_failures(spark, sf_dir):
    tried = V.digests(spark, sf_dir).withColumn("ok", F.col("doc_id") % 4 != 0)
    return dedup.survivors(tried).select("source_path", "status")


@query(f"WITH {V.DIGESTS}, old AS (SELECT DISTINCT digest FROM digests WHERE doc_id % 10 = 0) SELECT source_path FROM digests WHERE digest IN (SELECT digest FROM old)")
def known_digests(spark, sf_dir):
    """Through a catalog that is written and read again: a tenth of the documents is known, all are asked about."""
    d = V.digests(spark, sf_dir)
    return _catalog(spark, d.where("doc_id % 10 = 0")).is_known(d).select("source_path")


@query(
    f"""WITH {V.DIGESTS}, old AS (SELECT DISTINCT digest FROM digests WHERE doc_id % 10 = 0), firsts AS (SELECT *, min(source_path) OVER (PARTITION BY digest) AS first FROM digests)
    SELECT source_path, CASE WHEN digest NOT IN (SELECT digest FROM old) AND source_path = first THEN 'copied' ELSE 'duplicate' END AS status FROM firsts"""
)
def dry_run_statuses(spark, sf_dir):
    """What a run would do with every file, against a catalog that knows a tenth of the documents."""
    d = V.digests(spark, sf_dir)
    return dedup.mark_duplicates(d, _photos(d.where("doc_id % 10 = 0"), "old")).select("source_path", "status")


@query(f"WITH {_RANKED} SELECT '/dup/' || digest || '_' || regexp_extract(source_path, '[^/]+$') AS target, '/bad/' || left(sha256(source_path), 12) || '_' || regexp_extract(source_path, '[^/]+$') AS aside FROM ranked WHERE status = 'duplicate'")
def aside_paths(spark, sf_dir):
    again = dedup.mark_duplicates(V.digests(spark, sf_dir)).where("status = 'duplicate'")
    return again.select(X.duplicate_path("/dup", F.col("digest"), F.col("source_path")).alias("target"), X.quarantine_path("/bad", F.col("source_path")).alias("aside"))


@query(f"WITH {V.FILES} SELECT doc_id, {V.sql_digest('content')} = {V.sql_digest('CASE WHEN doc_id % 6 = 0 THEN content || chr(33) ELSE content END')} AS verified FROM files")
def verify_digest(spark, sf_dir):
    f = V.files(spark, sf_dir)
    stored = X.sha256_b64url(F.when(F.col("doc_id") % 6 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return f.select("doc_id", X.verify_digest(F.col("content"), stored).alias("verified"))


@query(f"WITH {V.DIGESTS} SELECT doc_id, sha256(digest) AS again, hex(from_base64(translate(digest, '-_', '+/') || '=')) AS raw FROM digests")
def digest_decode(spark, sf_dir):
    d = V.digests(spark, sf_dir)
    return d.select("doc_id", F.sha2("digest", 256).alias("again"), F.hex(X.b64url_decode(F.col("digest"))).alias("raw"))


@query(f"WITH {V.FILES} SELECT doc_id, left(sha256(source_path), 12) AS prefix FROM files")
def quarantine_prefix(spark, sf_dir):
    return V.files(spark, sf_dir).select("doc_id", X.quarantine_prefix(F.col("source_path")).alias("prefix"))


# --- names ------------------------------------------------------------------------


@query(f"SELECT p_partkey, {V.sql_descriptor('x')} AS descriptor FROM (SELECT p_partkey, p_name || ' ' || p_type || ', ' || p_brand AS x FROM part)")
def normalize_descriptor_parts(spark, sf_dir):
    x = F.concat("p_name", F.lit(" "), "p_type", F.lit(", "), "p_brand")
    return read_table(spark, sf_dir, "part").select("p_partkey", X.normalize_descriptor(x).alias("descriptor"))


@query(f"SELECT doc_id, {V.sql_descriptor('text')} AS descriptor, {V.sql_label('text')} AS norm FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def normalize_documents(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return read_table(spark, sf_dir, "documents").select("doc_id", X.normalize_descriptor(text).alias("descriptor"), X.normalize_label(text).alias("norm"))


@query(f"SELECT p_partkey, {V.sql_label('x')} AS norm FROM (SELECT p_partkey, p_name || 's & ' || p_type || 'es' AS x FROM part)")
def normalize_label_parts(spark, sf_dir):
    x = F.concat("p_name", F.lit("s & "), "p_type", F.lit("es"))
    return read_table(spark, sf_dir, "part").select("p_partkey", X.normalize_label(x).alias("norm"))


@query(f"SELECT page_id, {V.sql_slug('url')} AS slug FROM pages")
def slug_parts(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query(f"WITH {V.FILES}, w AS (SELECT doc_id, list_filter({V.sql_words(_STEM)}, lambda v: length(v) > 1) AS words FROM files) SELECT doc_id, coalesce(words[1], 'photo') AS subject, coalesce(array_to_string(words[1:3], '|'), '') AS tags FROM w")
def stub_words(spark, sf_dir):
    words = X.stub_words(_stem(F.col("source_path")))
    return V.files(spark, sf_dir).select("doc_id", F.coalesce(F.get(words, F.lit(0)), F.lit("photo")).alias("subject"), F.array_join(F.slice(words, 1, 3), "|").alias("tags"))


@query(f"WITH {V.FILES} SELECT {_EXT} AS ext, {_EXT} IN ({', '.join(map(V.quoted, C.EXTENSIONS))}) AS supported, count(*) AS files FROM files GROUP BY ALL")
def ext_filter(spark, sf_dir):
    f = V.files(spark, sf_dir).select(X.extension(F.col("source_path")).alias("ext"), X.is_supported(F.col("source_path")).alias("supported"))
    return f.groupBy("ext", "supported").agg(F.count("*").alias("files"))


@query(f"WITH {V.FILES} SELECT doc_id, {_STEM} AS stem, CASE {_EXT} " + " ".join(f"WHEN {V.quoted(k)} THEN {V.quoted(v)}" for k, v in C.MEDIA_TYPES.items()) + " ELSE 'image/jpeg' END AS media FROM files")
def path_parts(spark, sf_dir):
    p = F.col("source_path")
    return V.files(spark, sf_dir).select("doc_id", _stem(p).alias("stem"), X.media_type(X.extension(p)).alias("media"))


def _named(ext: str, desc: str, code: str = "'330'", sha: str = "digest") -> str:
    """CTEs that end in ``named(doc_id, filename)``."""
    return f"""n0 AS (SELECT doc_id, {code} AS code, {sha} AS sha, {V.sql_descriptor(desc)} AS d, regexp_replace(lower(regexp_extract({ext}, '[^.]*$')), '[^a-z0-9]', '', 'g') AS e FROM digests),
    n1 AS (SELECT *, length(code) + 2 + length(sha) AS fixed, CASE WHEN e = '' THEN 0 ELSE length(e) + 1 END AS tail FROM n0),
    n2 AS (SELECT *, CASE WHEN fixed + length(d) + tail > 100 THEN coalesce(nullif(rtrim(left(d, greatest(1, 100 - fixed - tail)), '-'), ''), left(d, 1)) ELSE d END AS s FROM n1),
    n3 AS (SELECT *, left(e, greatest(0, length(e) - greatest(0, fixed + length(s) + tail - 100))) AS k FROM n2),
    named AS (SELECT doc_id, code || '-' || s || '_' || sha || CASE WHEN k = '' THEN '' ELSE '.' || k END AS filename FROM n3)"""


@query(f"WITH {V.DIGESTS}, {_named(_EXT, _STEM)} SELECT doc_id, filename FROM named")
def filename_generate(spark, sf_dir):
    p = F.col("source_path")
    return V.digests(spark, sf_dir).select("doc_id", X.generate_filename(F.lit("330"), _stem(p), F.col("digest"), X.extension(p)).alias("filename"))


_LONG_EXT = "('Tar.' || repeat('xY-', (doc_id % 30)::INT))"


@query(f"WITH {V.DIGESTS}, {_named(_LONG_EXT, 'source_path', code=chr(39) + '540~1' + chr(39))} SELECT doc_id, filename, length(filename)::BIGINT AS n FROM named")
def filename_cap(spark, sf_dir):
    ext = F.concat(F.lit("Tar."), F.repeat(F.lit("xY-"), (F.col("doc_id") % 30).cast("int")))
    name = X.generate_filename(F.lit("540~1"), F.col("source_path"), F.col("digest"), ext)
    return V.digests(spark, sf_dir).select("doc_id", name.alias("filename")).withColumn("n", F.length("filename").cast("long"))


_CORRUPT = "CASE doc_id % 6 WHEN 0 THEN filename WHEN 1 THEN replace(filename, '-', '') WHEN 2 THEN 'x' || filename WHEN 3 THEN substr(filename, 5) WHEN 4 THEN replace(filename, '330-', '540~1-a-') ELSE '/out/a.b/' || filename END"
_PARSED = f"""{V.DIGESTS}, {_named(_EXT, _STEM)}, c AS (SELECT doc_id, {_CORRUPT} AS name FROM named),
    s AS (SELECT doc_id, name, regexp_replace(regexp_extract(name, '[^/]+$'), '\\.[^.]+$', '') AS stem FROM c),
    m AS (SELECT *, left(stem, greatest(0, length(stem) - 44)) AS prefix, length(stem) >= 47 AND substr(stem, length(stem) - 43, 1) = '_' AND regexp_matches(left(stem, greatest(0, length(stem) - 44)), '^[0-9]+(~[0-9]+)*-(.|\\n)+$') AS ok FROM s)"""


def _corrupted(spark, sf_dir):
    p, i, name = F.col("source_path"), F.col("doc_id") % 6, F.col("filename")
    named = V.digests(spark, sf_dir).withColumn("filename", X.generate_filename(F.lit("330"), _stem(p), F.col("digest"), X.extension(p)))
    broken = F.when(i == 0, name).when(i == 1, F.replace(name, F.lit("-"), F.lit(""))).when(i == 2, F.concat(F.lit("x"), name)).when(i == 3, F.substring(name, F.lit(5), F.length(name))).when(i == 4, F.replace(name, F.lit("330-"), F.lit("540~1-a-"))).otherwise(F.concat(F.lit("/out/a.b/"), name))
    return named.select("doc_id", "source_path", broken.alias("name"))


@query(f"WITH {_PARSED} SELECT doc_id, CASE WHEN ok THEN right(stem, 43) END AS digest FROM m")
def extract_digest(spark, sf_dir):
    return _corrupted(spark, sf_dir).select("doc_id", X.extract_digest(_stem(F.col("name"))).alias("digest"))


@query(f"WITH {_PARSED} SELECT doc_id, CASE WHEN ok THEN split_part(prefix, '-', 1) END AS code, CASE WHEN ok THEN substr(prefix, instr(prefix, '-') + 1) END AS descriptor, CASE WHEN ok THEN lower(regexp_extract(name, '[^.]+$')) END AS extension FROM m")
def filename_parse(spark, sf_dir):
    parsed = _corrupted(spark, sf_dir).select("doc_id", X.parse_filename(F.col("name")).alias("p"))
    return parsed.select("doc_id", "p.code", "p.descriptor", "p.extension")


# --- classes ----------------------------------------------------------------------

_NORMED = f"{V.CONTENT}, {V.SEEDS}, {V.LEARNED_SQL}, c AS (SELECT *, {V.sql_label('primary_subject')} AS subject_norm FROM content)"
_CLASSED = f"""{_NORMED}, t AS (SELECT pos, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS token FROM (SELECT pos, list_concat(objects, string_split(scene, ' ')) AS tokens FROM c)),
    hit AS (SELECT t.pos, arg_min(s.class, t.i) AS class FROM t JOIN seeds s ON s.subject = {V.sql_label('t.token')} GROUP BY t.pos),
    classed AS (SELECT c.pos, c.subject_norm, coalesce(l.class_code, s.class, hit.class) AS class FROM c LEFT JOIN learned l ON l.subject = c.subject_norm AND l.class_code IN ({V.CLASSES}) LEFT JOIN seeds s ON s.subject = c.subject_norm LEFT JOIN hit ON hit.pos = c.pos)"""


@query(f"WITH {_NORMED} SELECT c.pos, s.class FROM c LEFT JOIN seeds s ON s.subject = c.subject_norm")
def static_class(spark, sf_dir):
    bare = V.content(spark, sf_dir).withColumn("objects", F.array().cast("array<string>")).withColumn("scene", F.lit(""))
    return concepts.class_for(bare).select("pos", "class")


@query(f"WITH {_NORMED} SELECT c.pos, coalesce(l.class_code, s.class) AS class FROM c LEFT JOIN learned l ON l.subject = c.subject_norm AND l.class_code IN ({V.CLASSES}) LEFT JOIN seeds s ON s.subject = c.subject_norm")
def learned_over_static(spark, sf_dir):
    bare = V.content(spark, sf_dir).withColumn("objects", F.array().cast("array<string>")).withColumn("scene", F.lit(""))
    return concepts.class_for(bare, V.learned(spark)).select("pos", "class")


@query(f"WITH {_CLASSED} SELECT pos, class FROM classed")
def scene_token_class(spark, sf_dir):
    return concepts.class_for(V.content(spark, sf_dir), V.learned(spark)).select("pos", "class")


@query(f"WITH {_CLASSED} SELECT subject_norm, min(pos) AS pos FROM classed WHERE class IS NULL GROUP BY subject_norm")
def first_miss(spark, sf_dir):
    return concepts.first_misses(concepts.class_for(V.content(spark, sf_dir), V.learned(spark))).select("subject_norm", "pos")


@query(
    f"""WITH {_CLASSED}, a AS (SELECT subject_norm, min(pos) AS asked, CASE WHEN subject_norm LIKE '%y%' THEN '300' ELSE 'bogus' END AS answer FROM classed WHERE class IS NULL GROUP BY subject_norm)
    SELECT c.pos, CASE WHEN a.answer = '300' AND c.pos >= a.asked THEN '300' ELSE coalesce(c.class, '900') END AS class FROM classed c LEFT JOIN a USING (subject_norm)"""
)
def decide_class(spark, sf_dir):
    classed = concepts.class_for(V.content(spark, sf_dir), V.learned(spark))
    asked = concepts.first_misses(classed)
    answers = asked.select("subject_norm", "pos", F.when(F.col("subject_norm").contains("y"), "300").otherwise("bogus").alias("answer"))
    return concepts.decide_class(classed, answers).select("pos", "class")


@query(f"WITH {_NORMED}, d AS (SELECT subject_norm AS subject, CASE WHEN pos % 3 = 0 THEN '999' ELSE (pos % 9 + 1) || '00' END AS class_code, pos FROM c), n AS (SELECT subject, arg_max(class_code, pos) AS class_code, count(*) AS hits FROM d WHERE class_code IN ({V.CLASSES}) GROUP BY subject) SELECT subject, coalesce(n.class_code, l.class_code) AS class_code, coalesce(l.hits, 0) + coalesce(n.hits, 0) AS hits FROM learned l FULL JOIN n USING (subject)")
def learned_hits(spark, sf_dir):
    c = V.content(spark, sf_dir)
    code = F.when(F.col("pos") % 3 == 0, "999").otherwise(F.concat((F.col("pos") % 9 + 1).cast("string"), F.lit("00")))
    return concepts.remember(V.learned(spark), c.select(X.normalize_label(F.col("primary_subject")).alias("subject"), code.alias("class_code"), "pos"))


@query(f"WITH {V.ITEMS} SELECT pos, ({V.sql_label('label')} = '' OR {V.sql_label('label')} IN {V.DEGENERATE} OR NOT regexp_matches(label, '\\p{{L}}')) AS degenerate FROM items")
def degenerate_filter(spark, sf_dir):
    return V.items(spark, sf_dir).select("pos", X.is_degenerate(F.col("label")).alias("degenerate"))


@query(f"SELECT event_id, coalesce(list_filter(regexp_extract_all(props, '[0-9]+'), lambda r: r IN ({V.CLASSES}))[1], '900') AS code FROM (SELECT event_id, coalesce(props, '') || ' maybe ' || (event_id % 12) || '00 or 500' AS props FROM events)")
def first_valid_code(spark, sf_dir):
    answer = F.concat(F.coalesce("props", F.lit("")), F.lit(" maybe "), (F.col("event_id") % 12).cast("string"), F.lit("00 or 500"))
    return read_table(spark, sf_dir, "events").select("event_id", X.first_valid_code(answer).alias("code"))


@query("SELECT p_partkey, CASE WHEN code IN (" + ", ".join(V.quoted(c) for c, _, _ in C.seed_nodes()) + ") THEN code ELSE '900' END AS code FROM (SELECT p_partkey, (p_partkey % 100 * 10)::VARCHAR AS code FROM part)")
def resolve_category(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", X.resolve_code((F.col("p_partkey") % 100 * 10).cast("string")).alias("code"))


# --- taxonomy -----------------------------------------------------------------------

_REC = f"WITH RECURSIVE {V.TAXONOMY}"
_SLOT = """slot AS (SELECT code AS target, i, CASE WHEN regexp_matches(code, '^[1-9]00$') THEN code::INT + 10 * i WHEN regexp_matches(code, '^[1-9][1-9]0$') THEN code::INT + i END::VARCHAR AS slot
    FROM taxonomy, range(1, 10) r(i) WHERE regexp_matches(code, '^[1-9][0-9]0$') AND NOT regexp_matches(code, '^[1-9]0[1-9]$'))"""


@query(f"WITH {V.TREE}, {_SLOT} SELECT target AS code, string_agg(slot, ' ' ORDER BY i) AS slots FROM slot WHERE slot IS NOT NULL GROUP BY target")
def child_slots(spark, sf_dir):
    slots = V.tree(spark, sf_dir).select("code", X.child_slots(F.col("code")).alias("s"))
    return slots.where(F.size("s") > 0).select("code", F.array_join("s", " ").alias("slots"))


_FREE = "free AS (SELECT target, slot AS code, row_number() OVER (PARTITION BY target ORDER BY i) AS k FROM slot WHERE slot IS NOT NULL AND slot NOT IN (SELECT code FROM taxonomy))"


@query(f"WITH {V.TREE}, {_SLOT}, {_FREE} SELECT target, code, k FROM free")
def free_slots(spark, sf_dir):
    t = V.tree(spark, sf_dir)
    return T.free_slots(t, t.select(F.col("code").alias("target"))).withColumn("k", F.col("k").cast("long"))


_OVER = "over AS (SELECT parent_code AS target, max(substr(code, length(parent_code) + 2)::BIGINT) AS top FROM taxonomy WHERE starts_with(code, parent_code || '~') GROUP BY parent_code)"


@query(f"WITH {V.TREE}, {_OVER} SELECT target, top FROM over")
def max_overflow(spark, sf_dir):
    return T.overflow_counts(V.tree(spark, sf_dir))


@query(f"WITH RECURSIVE {V.TREE}, {V.CLOSURE} SELECT code, target FROM closure")
def alias_closure(spark, sf_dir):
    return T.alias_closure(V.tree(spark, sf_dir))


_RESOLVED = f"""{_REC}, {V.CLOSURE}, {V.ITEMS}, {_SLOT}, {_FREE}, {_OVER},
    aimed AS (SELECT i.*, cl.target, {V.sql_label('i.label')} AS norm FROM items i JOIN closure cl ON cl.code = CASE WHEN i.class IN (SELECT code FROM taxonomy) THEN i.class ELSE '900' END),
    nm AS (SELECT code, parent_code, {V.sql_label('name')} AS norm FROM (SELECT code, parent_code, unnest(list_concat([label], aliases)) AS name FROM taxonomy)),
    kid AS (SELECT parent_code, norm, min(code) AS code FROM nm WHERE parent_code IS NOT NULL GROUP BY ALL),
    placed AS (SELECT a.*, (a.norm = '' OR a.norm IN {V.DEGENERATE} OR NOT regexp_matches(a.label, '\\p{{L}}') OR EXISTS (SELECT 1 FROM nm WHERE nm.code = a.target AND nm.norm = a.norm)) AS stay, cl.target AS found
        FROM aimed a LEFT JOIN kid ON kid.parent_code = a.target AND kid.norm = a.norm LEFT JOIN closure cl ON cl.code = kid.code),
    fresh AS (SELECT target, norm, min(pos) AS pos, arg_min(label, pos) AS label FROM placed WHERE NOT stay AND found IS NULL GROUP BY target, norm),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS k FROM fresh),
    nfree AS (SELECT target, max(k) AS n FROM free GROUP BY target),
    minted AS (SELECT r.target, r.norm, r.label, coalesce(f.code, r.target || '~' || (coalesce(o.top, 0) + r.k - coalesce(n.n, 0))) AS code FROM ranked r LEFT JOIN free f ON f.target = r.target AND f.k = r.k LEFT JOIN nfree n ON n.target = r.target LEFT JOIN over o ON o.target = r.target)"""


@query(f"{_RESOLVED} SELECT code, target AS parent_code, label, code || '-' || {V.sql_slug('label')} AS folder_name FROM minted")
def mint_codes(spark, sf_dir):
    return T.resolve_or_create(V.items(spark, sf_dir), V.taxonomy(spark))[1].select("code", "parent_code", "label", "folder_name")


@query(f"{_RESOLVED} SELECT p.pos, CASE WHEN p.stay THEN p.target ELSE coalesce(p.found, m.code) END AS code FROM placed p LEFT JOIN minted m ON m.target = p.target AND m.norm = p.norm")
def resolve_codes(spark, sf_dir):
    return T.resolve_or_create(V.items(spark, sf_dir), V.taxonomy(spark))[0].select("pos", "code")


@query(f"WITH RECURSIVE {V.TREE}, up(code, parent, path) AS (SELECT code, parent_code, folder_name FROM taxonomy UNION ALL SELECT u.code, t.parent_code, t.folder_name || '/' || u.path FROM up u JOIN taxonomy t ON t.code = u.parent) SELECT code, arg_max(path, length(path)) AS folder_path FROM up GROUP BY code")
def folder_paths(spark, sf_dir):
    return T.folder_paths(V.tree(spark, sf_dir))


@query(f"WITH RECURSIVE {V.URL_NODES}, up(code, parent, path) AS (SELECT code, parent_code, folder_name FROM nodes UNION ALL SELECT u.code, t.parent_code, t.folder_name || '/' || u.path FROM up u JOIN nodes t ON t.code = u.parent) SELECT code, path AS folder_path FROM up WHERE parent IS NULL")
def url_folder_paths(spark, sf_dir):
    """The folders of a tree that is made of the pages' addresses."""
    return T.folder_paths(V.url_nodes(spark, sf_dir))


@query(
    """WITH e AS (SELECT event_id, user_id, row_number() OVER w AS n, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    f AS (SELECT user_id, event_id AS fifth FROM e WHERE n = 5 AND user_id % 7 = 0)
    SELECT event_id AS code, CASE WHEN fifth IS NULL THEN first WHEN n <= 5 THEN event_id ELSE fifth END AS target FROM e LEFT JOIN f USING (user_id)"""
)
def alias_chains(spark, sf_dir):
    """Where long chains of events lead to: the user's first event, or the cycle that some users' first events close."""
    links = V.event_links(spark, sf_dir).select("code", F.col("to").alias("alias_of"))
    return T.alias_closure(links)


@query(f"WITH RECURSIVE {V.TREE}, down(code, label, sort_path, depth) AS (SELECT code, label, code, 0 FROM taxonomy WHERE active AND parent_code IS NULL UNION ALL SELECT t.code, t.label, d.sort_path || '/' || t.code, d.depth + 1 FROM down d JOIN taxonomy t ON t.parent_code = d.code AND t.active) SELECT sort_path, repeat('  ', depth) || code || ' ' || label AS line FROM down")
def snapshot_tree(spark, sf_dir):
    return T.snapshot_lines(V.tree(spark, sf_dir)).select("sort_path", "line")


@query(f"WITH {V.TREE} SELECT code, label FROM taxonomy WHERE parent_code IS NULL UNION ALL SELECT code, label FROM taxonomy WHERE parent_code = '500'")
def taxonomy_children(spark, sf_dir):
    t = V.tree(spark, sf_dir)
    return T.children(t, None).select("code", "label").unionByName(T.children(t, "500").select("code", "label"))


@query(f"WITH {V.TREE} SELECT code, label FROM taxonomy WHERE active")
def taxonomy_active(spark, sf_dir):
    return T.active(V.tree(spark, sf_dir)).select("code", "label")


@query(f"WITH {V.TREE} SELECT code, array_to_string(CASE WHEN code = '500' THEN list_append(aliases, 'sports') ELSE aliases END, '|') AS aliases, CASE WHEN code = '510' THEN '500' ELSE alias_of END AS alias_of, active AND code <> '510' AS active FROM taxonomy")
def merge_codes(spark, sf_dir):
    t = T.merge_codes(T.merge_codes(V.tree(spark, sf_dir), "510", "500"), "nope", "500")
    return t.select("code", F.array_join("aliases", "|").alias("aliases"), "alias_of", "active")


@query(f"WITH {V.TREE} SELECT code, label, parent_code FROM taxonomy UNION ALL SELECT '900~' || (p_partkey + 1000000000), p_name, '900' FROM part WHERE p_partkey % 3 <> 0")
def taxonomy_insert(spark, sf_dir):
    """A node for every part again: a third of them conflict with nodes that are there, and each comes twice."""
    tree, p = V.tree(spark, sf_dir), F.col("p_partkey")
    code = F.when(p % 3 == 0, V._part_code(p)).otherwise(F.concat(F.lit("900~"), (p + 1000000000).cast("string")))
    new = T.node_rows(read_table(spark, sf_dir, "part").select(code.alias("code"), F.lit("900").alias("parent_code"), F.col("p_name").alias("label")))
    return T.insert(tree, new.unionByName(new)).select("code", "label", "parent_code")


@query(f"WITH {V.TREE} SELECT code, CASE WHEN code = '500' THEN 'parties|fairs' ELSE array_to_string(aliases, '|') END AS aliases, CASE WHEN code = '550' THEN '500' WHEN code = '560' THEN NULL ELSE alias_of END AS alias_of FROM taxonomy")
def taxonomy_set_aliases(spark, sf_dir):
    t = T.set_alias(T.set_alias(T.set_aliases(V.tree(spark, sf_dir), "500", ["parties", "fairs"]), "550", "500"), "560", None)
    return t.select("code", F.array_join("aliases", "|").alias("aliases"), "alias_of")


@query(f"WITH {V.TREE}, {V.LEARNED_SQL} SELECT code AS key, label AS value FROM taxonomy WHERE code IN ('111', '110') UNION ALL SELECT subject, class_code FROM learned WHERE subject = 'beach photo'")
def keyed_reads(spark, sf_dir):
    t = V.tree(spark, sf_dir)
    nodes = T.get(t, "111").unionByName(T.get(t, "110")).unionByName(T.get(t, "nope")).select(F.col("code").alias("key"), F.col("label").alias("value"))
    return nodes.unionByName(concepts.learned_get(V.learned(spark), "Beach  Photos").select(F.col("subject").alias("key"), F.col("class_code").alias("value")))


@query(f"WITH {V.TREE} SELECT code, label, parent_code FROM spine UNION ALL SELECT code, label, parent_code FROM taxonomy WHERE contains(code, '~')")
def seed_if_empty(spark, sf_dir):
    """The spine where the table is empty; a table with rows, here without a spine, stays as it is."""
    t = V.tree(spark, sf_dir)
    return T.seed_taxonomy(spark, t.where("false")).unionByName(T.seed_taxonomy(spark, t.where("contains(code, '~')"))).select("code", "label", "parent_code")


# --- passes -------------------------------------------------------------------------


@query(f"WITH {V.SEEN} SELECT source_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_path = f.source_path AND s.size = f.size AND s.mtime_ns = f.mtime_ns)")
def seen_anti_join(spark, sf_dir):
    f = V.files(spark, sf_dir).drop("content")
    return incremental.unseen(f, V.seen(f)).select("source_path")


@query(f"WITH {V.SEEN} SELECT f.source_path, s.size AS old_size, f.size FROM files f JOIN seen s USING (source_path) WHERE s.size <> f.size OR s.mtime_ns <> f.mtime_ns")
def changed_files(spark, sf_dir):
    f = V.files(spark, sf_dir).drop("content")
    return incremental.changed(f, V.seen(f)).select("source_path", "old_size", "size")


@query(f"WITH {V.SEEN} SELECT coalesce(f.source_path, s.source_path) AS source_path, coalesce(f.size, s.size) AS size, coalesce(f.mtime_ns, s.mtime_ns) AS mtime_ns FROM (SELECT * FROM files WHERE doc_id % 2 = 0) f FULL JOIN seen s USING (source_path)")
def record_source_seen(spark, sf_dir):
    f = V.files(spark, sf_dir).drop("content")
    return incremental.record_seen(V.seen(f), f.where("doc_id % 2 = 0")).select("source_path", "size", "mtime_ns")


@query(f"WITH {V.FILES} SELECT source_path FROM files WHERE doc_id % 3 <> 0")
def clear_file_failure(spark, sf_dir):
    f = V.files(spark, sf_dir).drop("content")
    return incremental.clear_failures(f, f.where("doc_id % 3 = 0")).select("source_path")  # all have failed, a third succeeds


@query(f"WITH {V.FILES} SELECT source_path FROM files WHERE NOT (doc_id % 4 = 1 AND doc_id % 8 <> 5)")
def quarantine_filter(spark, sf_dir):
    f, i = V.files(spark, sf_dir).drop("content"), F.col("doc_id")
    failed = f.where(i % 4 != 0).select("source_path", "size", F.when(i % 8 == 5, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), (i % 4 == 1).alias("quarantined"))
    return incremental.not_quarantined(f, failed).select("source_path")


@query(
    f"""WITH {V.ATTEMPTS}, e AS (SELECT *, CASE WHEN lag(size) OVER (PARTITION BY source_path ORDER BY event_id) <> size THEN 1 ELSE 0 END AS moved FROM attempts WHERE status = 'error'),
    v AS (SELECT source_path, sum(moved) OVER (PARTITION BY source_path ORDER BY event_id) AS version FROM e),
    n AS (SELECT source_path, version, count(*) AS n FROM v GROUP BY ALL) SELECT source_path, arg_max(n, version) AS fail_count FROM n GROUP BY source_path"""
)
def fail_counter(spark, sf_dir):
    return incremental.fail_counts(V.attempts(spark, sf_dir).where("status = 'error'"), "event_id", "source_path", "size")


def _failures_before_and_after(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(source_path, size, fail_count of the first half of the log; source_path, size of the second half)."""
    errors = V.attempts(spark, sf_dir).where("status = 'error'")
    old = errors.where("day < '2024-01-15'").groupBy("source_path").agg(F.max("size").alias("size"), F.count("*").cast("int").alias("fail_count"))
    return old, errors.where("day >= '2024-01-15'").groupBy("source_path").agg(F.max("size").alias("size"))


@query(
    f"""WITH {V.ATTEMPTS}, old AS (SELECT source_path, max(size) AS size, count(*) AS n FROM attempts WHERE status = 'error' AND day < '2024-01-15' GROUP BY source_path),
    new AS (SELECT source_path, max(size) AS size FROM attempts WHERE status = 'error' AND day >= '2024-01-15' GROUP BY source_path)
    SELECT source_path, coalesce(n.size, o.size) AS size, (CASE WHEN n.size IS NULL THEN o.n WHEN o.size = n.size THEN o.n + 1 ELSE 1 END)::INT AS fail_count,
        (CASE WHEN n.size IS NULL THEN o.n % 2 = 0 WHEN o.size = n.size THEN o.n % 2 = 0 OR o.n + 1 >= 5 ELSE FALSE END) AS quarantined
    FROM old o FULL JOIN new n USING (source_path)"""
)
def poison_reconcile(spark, sf_dir):
    old, new = _failures_before_and_after(spark, sf_dir)
    stamp = F.lit("2024-01-15").cast("timestamp")
    failed = old.select("source_path", "size", F.lit(1).cast("long").alias("mtime_ns"), "fail_count", F.lit("boom").alias("last_error"), stamp.alias("first_failed_at"), stamp.alias("last_failed_at"), (F.col("fail_count") % 2 == 0).alias("quarantined"))
    new = new.select("source_path", "size", F.lit(1).cast("long").alias("mtime_ns"), F.lit("bang").alias("error"))
    return incremental.record_failures(failed, new, "2024-02-01").select("source_path", "size", "fail_count", "quarantined")


@query(_SQL["fail_counter"])
def fail_counter_stream(spark, sf_dir):
    """The same counts as a stream's keyed state, from three micro-batches with a restart between them."""
    errors = V.attempts(spark, sf_dir).where("status = 'error'")
    log = errors.select("day", "source_path", "size", F.lit(1).cast("long").alias("mtime_ns"), F.lit(True).alias("failed"), F.col("event_id").alias("at"))
    parts = [log.where("day < '2024-01-10'"), log.where("day >= '2024-01-10' AND day < '2024-01-20'"), log.where("day >= '2024-01-20'")]
    return failures.latest(failures.replayed(spark, parts)).select("source_path", F.col("fail_count").cast("long").alias("fail_count"))


@query(_SQL["poison_reconcile"])
def poison_reconcile_stream(spark, sf_dir):
    """A pass of failures over a table of old ones, which is the initial state of the stream."""
    old, new = _failures_before_and_after(spark, sf_dir)
    one = F.lit(1).cast("long")
    before = stored(old.select("source_path", "size", one.alias("mtime_ns"), "fail_count", (F.col("fail_count") % 2 == 0).alias("quarantined")))
    changes = failures.replayed(spark, [new.select("source_path", "size", one.alias("mtime_ns"), F.lit(True).alias("failed"), one.alias("at"))], before=before)
    now = failures.latest(changes).unionByName(before.join(changes.select("source_path"), "source_path", "left_anti"))
    return now.select("source_path", "size", "fail_count", "quarantined")


_RUNS = f"""WITH {V.ATTEMPTS}, i AS (SELECT *, sum(CASE WHEN status = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY event_id) AS isle FROM attempts),
    r AS (SELECT *, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY day, isle ORDER BY event_id) AS run FROM i)"""


@query(f"{_RUNS} SELECT day, event_id, run::BIGINT AS run FROM r WHERE status = 'error' AND run >= 3")
def breaker_trip(spark, sf_dir):
    return dedup.breaker_trips(V.attempts(spark, sf_dir), 3, ["event_id"], ["day"]).where("trips").select("day", "event_id", "run")


@query(f"{_RUNS}, f AS (SELECT day, min(event_id) AS at FROM r WHERE status = 'error' AND run >= 3 GROUP BY day) SELECT day, count(*) FILTER (f.at IS NULL OR r.event_id <= f.at) AS tried, count(*) AS total FROM r LEFT JOIN f USING (day) GROUP BY day")
def untried_after_trip(spark, sf_dir):
    tripped = dedup.breaker_trips(V.attempts(spark, sf_dir), 3, ["event_id"], ["day"])
    return dedup.untried_after_trip(tripped, "event_id", ["day"]).groupBy("day").agg(F.count_if("tried").alias("tried"), F.count("*").alias("total"))


@query(f"WITH {V.ATTEMPTS}, p AS (SELECT day, count(*) FILTER (status <> 'error') AS processed, count(*) FILTER (status = 'error') AS errors, bool_or(status <> 'error') AS any_success FROM attempts GROUP BY day) SELECT day, processed, errors, any_success, (sum(processed) OVER (ORDER BY day))::BIGINT AS total_processed FROM p")
def pass_stats(spark, sf_dir):
    from pyspark.sql import Window

    per = incremental.healthy_passes(V.attempts(spark, sf_dir), "day")
    return per.withColumn("total_processed", F.sum("processed").over(Window.orderBy("day")))  # one row per pass


# --- catalog ------------------------------------------------------------------------


def _photos(files: DataFrame, event: str) -> DataFrame:
    one = files.groupBy("digest").agg(F.min("source_path").alias("original_path"))
    stamp = F.lit("2024-01-01").cast("timestamp")
    text = lambda x: F.lit(x).cast("string")
    none = F.array().cast("array<string>")
    return one.select(
        "digest", "original_path", F.when(~F.col("digest").startswith("A"), F.concat(F.lit(f"/{event}/"), "digest")).alias("organized_path"), text("1").alias("pcs_version"), text("900").alias("pcs_primary"), text(event).alias("pcs_name"),
        none.alias("secondary_tags"), text("").alias("ai_caption"), none.alias("objects"), text("").alias("ocr_text"), text("{}").alias("exif"), text("stub").alias("model_version"), stamp.alias("created_at"), stamp.alias("processed_at"),
    )


def _commit(catalog: K.Catalog, files: DataFrame, event: str) -> None:
    """A batch of photos, and an event of each in the history."""
    new, text = stored(_photos(files, event)), lambda c: F.lit(None).cast("string").alias(c)
    events = new.select("digest", F.lit(event).alias("event"), F.col("original_path").alias("source"), text("destination"), text("duplicate_path"), F.lit(None).cast("timestamp").alias("at"))
    catalog.commit(photos=catalog.upsert(new), history=events)


def _catalog(spark, files: DataFrame) -> K.Catalog:
    """A catalog in the shared folder that holds these files; it goes when the driver ends."""
    catalog = K.Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}").delete_on_exit()
    _commit(catalog, files, "old")
    return catalog


def _old(where: str = "true") -> str:
    return f"{V.DIGESTS}, old AS (SELECT *, row_number() OVER (ORDER BY original_path, digest) AS id FROM (SELECT digest, min(source_path) AS original_path FROM digests WHERE {where} GROUP BY digest))"


_OLD = _old()


@query(
    f"""WITH {_old("doc_id % 2 = 0")}, new AS (SELECT digest, min(source_path) AS original_path FROM digests WHERE doc_id % 4 <> 0 GROUP BY digest),
    fresh AS (SELECT digest, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY original_path, digest) AS id FROM new WHERE digest NOT IN (SELECT digest FROM old)),
    u AS (SELECT digest, o.original_path AS a, n.original_path AS b, CASE WHEN n.digest IS NULL THEN 'old' ELSE 'new' END AS kind, CASE WHEN o.digest IS NULL OR n.digest IS NULL THEN 1 ELSE 2 END AS events FROM old o FULL JOIN new n USING (digest))
    SELECT coalesce(o.id, f.id)::BIGINT AS id, u.digest, coalesce(a, b) AS original_path, CASE WHEN u.digest NOT LIKE 'A%' THEN '/' || kind || '/' || u.digest END AS organized_path, kind AS pcs_name, events::BIGINT AS events
    FROM u LEFT JOIN old o ON o.digest = u.digest LEFT JOIN fresh f ON f.digest = u.digest"""
)
def upsert_photos(spark, sf_dir):
    d = V.digests(spark, sf_dir)  # even ids are in the catalog, and all but a quarter come (again): some old, some new, some both
    catalog = _catalog(spark, d.where("doc_id % 2 = 0"))
    _commit(catalog, d.where("doc_id % 4 <> 0"), "new")
    events = catalog.read("history").groupBy("digest").agg(F.count("*").alias("events"))
    return catalog.read("photos").join(events, "digest").select("id", "digest", "original_path", "organized_path", "pcs_name", "events")


@query(f"WITH {_OLD} SELECT id::BIGINT AS id, left(digest, 12) || '…  ' || '  900' || '  ' || CASE WHEN digest LIKE 'A%' THEN 'None' ELSE '/old/' || digest END AS line FROM old ORDER BY id LIMIT 50")
def list_limit(spark, sf_dir):
    return K.listing(_catalog(spark, V.digests(spark, sf_dir)).read("photos"), C.LIST_LIMIT)


@query(f"WITH {_OLD} SELECT count(*) AS photos FROM old")
def count_photos(spark, sf_dir):
    return _catalog(spark, V.digests(spark, sf_dir)).read("photos").agg(F.count("*").alias("photos"))


@query(f"WITH {_OLD} SELECT digest, 'old' AS event, original_path AS path FROM old UNION ALL SELECT d.digest, 'duplicate_detected', d.source_path FROM digests d JOIN old o ON d.digest = o.digest AND d.source_path <> o.original_path")
def mark_duplicates(spark, sf_dir):
    """The history of a catalog after a pass that has found every copy: a row an event."""
    d = V.digests(spark, sf_dir)
    again = dedup.mark_duplicates(d).where("status = 'duplicate'")
    catalog = _catalog(spark, d)
    catalog.commit(history=K.duplicate_events(catalog.touched("photos", again), again, "2024-02-01"))
    return catalog.read("history").select("digest", "event", F.coalesce("duplicate_path", "source").alias("path"))


@query("SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 1 ELSE 3 END::BIGINT AS batch FROM conversations")
def history_append(spark, sf_dir):
    """Conversations as an event table: two batches of turns, kept as rows by conversation and turn."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    spec = Table("conv_id long, batch long, turn long, role string", "conv_id", keyed=False, order=("turn",))
    log = DeltaLog(spark, f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}", {"turns": spec}).delete_on_exit()
    log.commit(turns=turns.where("turn % 2 = 0"))
    log.commit(turns=turns.where("turn % 2 <> 0"))
    return log.read("turns").select("conv_id", "turn", "role", "batch")


@query(f"WITH {_OLD} SELECT digest, original_path FROM old WHERE original_path = (SELECT min(original_path) FROM old) UNION ALL SELECT digest, original_path FROM old WHERE digest = (SELECT max(digest) FROM old)")
def catalog_by_key(spark, sf_dir):
    """One photo by its path, one by its digest, from a catalog that holds all documents."""
    d = V.digests(spark, sf_dir)
    catalog = _catalog(spark, d)
    ends = catalog.read("photos").agg(F.min("original_path").alias("path"), F.max("digest").alias("digest")).first()
    both = catalog.get_by_original_path(ends["path"]).select("digest", "original_path").unionByName(catalog.get(ends["digest"]).select("digest", "original_path"))
    return both


# --- files --------------------------------------------------------------------------


def _exported(spark, sf_dir) -> str:
    """The documents as files below the shared folder, which all executors mount; names end in a code that is no picture's for some.

    A shared folder that is no mounted path is refused. The files go when the driver ends.
    """
    shared = shared_dir(spark)
    if "://" in shared and not shared.startswith("file:///"):
        raise RuntimeError(f"files need a shared folder that is mounted as a path, which {shared} is not")
    root = f"/{shared.removeprefix('file:').lstrip('/')}/files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file:{root}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    files_ = V.files(spark, sf_dir).select(F.concat(F.lit(root), "source_path").alias("path"), "content")

    def write(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    files_.mapInArrow(write, "path string").count()
    return root


@query(f"WITH {V.DIGESTS} SELECT source_path, size, digest FROM digests WHERE {_EXT} IN ({', '.join(map(V.quoted, C.EXTENSIONS))})")
def scan_files(spark, sf_dir):
    """Every document as a file on disk: listed, filtered by extension, hashed."""
    from stowage.sources import files

    root = _exported(spark, sf_dir)
    return files.with_digests(files.scan(spark, root)).select(F.substring("source_path", len(root) + 1, 1 << 20).alias("source_path"), "size", "digest")


@query(f"WITH {V.FILES} SELECT 'deep' AS mode, count(*) AS files FROM files UNION ALL SELECT 'flat', 0 UNION ALL SELECT 'single', 1")
def scan_modes(spark, sf_dir):
    from stowage.sources import files

    root = _exported(spark, sf_dir)
    deep = files.scan(spark, root, supported_only=False)
    one = deep.agg(F.min("source_path")).first()[0]
    counts = [(mode, df.count()) for mode, df in (("deep", deep), ("flat", files.scan(spark, root, recursive=False)), ("single", files.scan(spark, one, supported_only=False)))]
    return spark.createDataFrame(counts, "mode string, files long")


@query(f"WITH {V.DIGESTS}, {_named(_EXT, _STEM)} SELECT filename, 'copied' AS status, 'OK' AS verdict FROM named WHERE doc_id IN (SELECT doc_id FROM digests WHERE {_EXT} IN ({', '.join(map(V.quoted, C.EXTENSIONS))}))")
def copy_and_verify(spark, sf_dir):
    """Every picture copied under its generated name (twice, as after an interruption) with a sidecar, then verified by name."""
    from stowage.plans.organize import verify_tree
    from stowage.sources import files, sinks

    root = _exported(spark, sf_dir)
    p = F.col("source_path")
    named = files.with_digests(files.scan(spark, f"{root}/src")).drop("error").withColumn("filename", X.generate_filename(F.lit("330"), _stem(p), F.col("digest"), X.extension(p)))
    planned = named.withColumn("organized_path", F.concat(F.lit(f"{root}/out/"), F.substring(F.sha2(p, 256), 1, 16), F.lit("/"), "filename")).withColumn("sidecar", F.to_json(F.struct("digest")))
    sinks.organize_files(planned, f"{root}/out", True)
    copied = sinks.organize_files(planned, f"{root}/out", True).select("organized_path", "filename", "status")
    return copied.join(verify_tree(spark, f"{root}/out").withColumnRenamed("source_path", "organized_path"), "organized_path").select("filename", "status", "verdict")


# --- the whole chain ------------------------------------------------------------------

_CHAIN = f"""{V.DIGESTS}, {V.SEEDS}, words AS (SELECT *, coalesce((list_filter({V.sql_words(_STEM)}, lambda v: length(v) > 1))[1], 'photo') AS subject FROM digests),
    firsts AS (SELECT *, min(source_path) OVER (PARTITION BY digest) AS first FROM words),
    items AS (SELECT doc_id AS pos, coalesce(s.class, '900') AS class, f.subject AS label FROM firsts f LEFT JOIN seeds s ON s.subject = {V.sql_label('f.subject')} WHERE source_path = first)"""
_CHAIN_RESOLVED = _RESOLVED.replace(V.ITEMS, _CHAIN)
_CHAIN_NAMED = _named(_EXT, "subject", code="code").replace("FROM digests)", "FROM coded)")


@query(
    f"""{_CHAIN_RESOLVED}, coded AS (SELECT w.*, CASE WHEN p.stay THEN p.target ELSE coalesce(p.found, m.code) END AS code FROM placed p LEFT JOIN minted m ON m.target = p.target AND m.norm = p.norm JOIN words w ON w.doc_id = p.pos),
    nodes AS (SELECT code, parent_code, folder_name FROM taxonomy UNION ALL SELECT code, target, code || '-' || {V.sql_slug('label')} FROM minted),
    up(code, parent, path) AS (SELECT code, parent_code, folder_name FROM nodes UNION ALL SELECT u.code, t.parent_code, t.folder_name || '/' || u.path FROM up u JOIN nodes t ON t.code = u.parent),
    paths AS (SELECT code, arg_max(path, length(path)) AS folder_path FROM up GROUP BY code), {_CHAIN_NAMED}
    SELECT n.doc_id, n.code, '/out/' || p.folder_path || '/' || n.filename AS organized_path FROM (SELECT named.*, coded.code FROM named JOIN coded USING (doc_id)) n JOIN paths p ON p.code = n.code"""
)
def organize_documents(spark, sf_dir):
    """From bytes to organized path: digest, first copies, description, class, code (minted if need be), folder, name."""
    first = dedup.mark_duplicates(V.digests(spark, sf_dir)).where("status = 'copied'").withColumn("pos", F.col("doc_id"))
    described = stored(StubClassifier().describe_files(first))
    classed = concepts.class_for(described)
    decided = concepts.decide_class(classed, StubClassifier().answer(concepts.first_misses(classed)))
    nodes = V.taxonomy(spark)
    coded, minted = T.resolve_or_create(stored(decided.withColumn("label", F.col("primary_subject"))), nodes)
    placed = coded.join(T.folder_paths(stored(T.insert(nodes, minted))), "code")
    name = X.generate_filename(F.col("code"), F.col("primary_subject"), F.col("digest"), X.extension(F.col("source_path")))
    return placed.select("doc_id", "code", F.concat(F.lit("/out/"), "folder_path", F.lit("/"), name).alias("organized_path"))


_IS_PICTURE = f"{_EXT} IN ({', '.join(map(V.quoted, C.EXTENSIONS))})"
_RUN = _RESOLVED.replace(V.TAXONOMY, V.SPINE).replace(V.ITEMS, _CHAIN.replace("AS subject FROM digests)", f"AS subject FROM digests WHERE {_IS_PICTURE})").replace("doc_id AS pos", "source_path AS pos"))


@query(
    f"""{_RUN}, coded AS (SELECT w.*, CASE WHEN p.stay THEN p.target ELSE coalesce(p.found, m.code) END AS code FROM placed p LEFT JOIN minted m ON m.target = p.target AND m.norm = p.norm JOIN words w ON w.source_path = p.pos),
    nodes AS (SELECT code, parent_code, folder_name FROM taxonomy UNION ALL SELECT code, target, code || '-' || {V.sql_slug('label')} FROM minted),
    up(code, parent, path) AS (SELECT code, parent_code, folder_name FROM nodes UNION ALL SELECT u.code, t.parent_code, t.folder_name || '/' || u.path FROM up u JOIN nodes t ON t.code = u.parent),
    paths AS (SELECT code, arg_max(path, length(path)) AS folder_path FROM up GROUP BY code), {_CHAIN_NAMED},
    ids AS (SELECT source_path, row_number() OVER (ORDER BY source_path) AS id FROM coded), times AS (SELECT digest, count(*) AS events FROM words GROUP BY digest)
    SELECT ids.id::BIGINT AS id, c.digest, c.source_path AS original_path, c.code AS pcs_primary, p.folder_path || '/' || n.filename AS organized_path, t.events
    FROM coded c JOIN named n USING (doc_id) JOIN paths p ON p.code = c.code JOIN ids USING (source_path) JOIN times t ON t.digest = c.digest"""
)
def organizer_run(spark, sf_dir):
    """The catalog after a run over every picture on disk: scanned, hashed, described, coded, copied, verified, committed."""
    from stowage.plans.organize import Organizer
    from stowage.sources import files

    root = _exported(spark, sf_dir)
    catalog = K.Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}").delete_on_exit()
    Organizer(catalog, f"{root}/out").run(files.scan(spark, f"{root}/src")).count()
    events = catalog.read("history").groupBy("digest").agg(F.count("*").alias("events"))
    bare = lambda c, top: F.substring(c, len(root) + len(top) + 1, 1 << 20)
    return catalog.read("photos").join(events, "digest").select("id", "digest", bare("original_path", "").alias("original_path"), "pcs_primary", bare("organized_path", "/out/").alias("organized_path"), "events")


@query(f"WITH {_OLD} SELECT id::BIGINT AS id, digest, original_path FROM old ORDER BY id")
def catalog_scan(spark, sf_dir):
    return _catalog(spark, V.digests(spark, sf_dir)).all().select("id", "digest", "original_path")


@query(f"WITH {_RANKED} SELECT digest || '_' || regexp_extract(source_path, '[^/]+$') AS name, size, digest FROM ranked WHERE status = 'duplicate'")
def copies_aside(spark, sf_dir):
    """Every duplicate copied to a folder of its own, which is listed and hashed."""
    from stowage.sources import files, sinks

    root = _exported(spark, sf_dir)
    again = dedup.mark_duplicates(V.digests(spark, sf_dir)).where("status = 'duplicate'")
    target = X.duplicate_path(f"{root}/dup", F.col("digest"), F.col("source_path"))
    sinks.copy_aside(again.select(F.concat(F.lit(root), "source_path").alias("source_path"), target.alias("target"))).count()
    read = files.with_digests(files.scan(spark, f"{root}/dup", supported_only=False))
    return read.select(X.base_name(F.col("source_path")).alias("name"), "size", "digest")


@query(f"WITH {V.DIGESTS} SELECT {_STEM} || '.json' AS name, digest, doc_id FROM digests WHERE {_IS_PICTURE}")
def sidecars(spark, sf_dir):
    """A sidecar beside every copied picture, read back as JSON."""
    from stowage.sources import files, sinks

    root = _exported(spark, sf_dir)
    p = F.concat(F.lit(root), "source_path")
    known = V.digests(spark, sf_dir).where(X.is_supported(F.col("source_path")))
    planned = known.select(p.alias("source_path"), F.concat(F.lit(f"{root}/out"), "source_path").alias("organized_path"), "digest", F.to_json(F.struct("digest", "doc_id")).alias("sidecar"))
    sinks.organize_files(planned, f"{root}/out", True)
    texts = files.with_texts(files.scan(spark, f"{root}/out", extensions=("json",)))
    read = texts.select(X.base_name(F.col("source_path")).alias("name"), F.from_json("text", "digest string, doc_id long").alias("said"))
    return read.select("name", "said.digest", "said.doc_id")


# --- numbers and JSON ---------------------------------------------------------------


@query("SELECT c_custkey, round((CASE WHEN c_custkey % 4 IN (1, 3) THEN -1 ELSE 1 END) * (c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 50) / 3600.0::DOUBLE), 6) AS decimal FROM customer")
def dms_decimal(spark, sf_dir):
    k = F.col("c_custkey")
    ref = V.pick(k, ("N", "s", "E", "W"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.round(X.dms_to_decimal((k % 90).cast("double"), k % 60, k % 50, ref), 6).alias("decimal"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity / (l_linenumber % 3) END::DOUBLE AS value FROM lineitem")
def rational_values(spark, sf_dir):
    den = F.col("l_linenumber") % 3
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.rational(F.col("l_quantity"), den).alias("value"))


@query("SELECT event_id, json_valid(raw) AS valid FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{broken' ELSE '{\"n\": ' || event_id || '}' END AS raw FROM events)")
def json_fallback(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"n": '), i.cast("string"), F.lit("}")))
    return read_table(spark, sf_dir, "events").select("event_id", X.json_decode(raw).isNotNull().alias("valid"))


@query(f"WITH {_PARSED}, v AS (SELECT m.*, CASE WHEN NOT lower(regexp_extract(name, '[^.]+$')) IN ({', '.join(map(V.quoted, C.EXTENSIONS))}) OR NOT ok THEN 'SKIP' WHEN right(stem, 43) = digest THEN 'OK' ELSE 'FAIL' END AS verdict FROM m JOIN (SELECT doc_id, {V.sql_digest('CASE WHEN doc_id % 9 = 0 THEN content || chr(33) ELSE content END')} AS digest FROM files) USING (doc_id)) SELECT verdict, count(*) AS files FROM v GROUP BY verdict")
def verify_stats(spark, sf_dir):
    from stowage.plans.organize import verdict

    now = V.files(spark, sf_dir).select("doc_id", X.sha256_b64url(F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("actual"))
    named = _corrupted(spark, sf_dir).select("doc_id", "name").join(now, "doc_id")
    return named.select(verdict(F.col("name"), F.col("actual")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("files"))


@query("SELECT c_custkey, round_even((c_custkey % 360) / 7.0::DOUBLE, 7) AS rounded FROM customer")
def round_coordinates(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", X.round7((F.col("c_custkey") % 360).cast("double") / F.lit(7.0)).alias("rounded"))


@query("SELECT p_partkey, json_object('id', p_partkey, 'name', p_name, 'size', CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END)::VARCHAR AS encoded FROM part")
def json_encode(spark, sf_dir):
    size = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    return read_table(spark, sf_dir, "part").select("p_partkey", X.json_encode(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), size.alias("size")).alias("encoded"))


_LISTS = "CASE p_partkey % 4 WHEN 0 THEN '[\"a\", ' || p_size || ', true]' WHEN 1 THEN '\"text\"' WHEN 2 THEN '{broken' ELSE '[]' END"


@query(f"SELECT p_partkey, array_to_string(CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'ARRAY' THEN json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$[*]') ELSE [] END, '|') AS items, coalesce(nullif(subject, ''), 'photo') AS subject FROM (SELECT p_partkey, {_LISTS} AS raw, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS subject FROM part)")
def coerced_fields(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit('["a", '), F.col("p_size").cast("string"), F.lit(", true]"))).when(k == 1, '"text"').when(k == 2, "{broken").otherwise("[]")
    subject = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.coerce_list(raw), "|").alias("items"), X.coerce_subject(subject).alias("subject"))
