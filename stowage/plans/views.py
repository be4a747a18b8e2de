"""Views that turn the driver's tables into files, names, attempts and nodes; each in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import constants as C
from stowage.functions import expressions as X
from stowage.operators import taxonomy as T
from stowage.session import read_table

STEMS = ("beach_photo", "mountain_view", "dog_park", "marching_band", "zonkle", "none", "family_picnic", "receipt_scan", "old_church", "red_car", "sunset_lake", "birthday_cake", "wedding_dance", "cat_nap", "quokka_smile", "x", "blue_whale", "train_station", "city_lights", "mystery_box", "food_market", "horse_race", "landscape_study", "portrait_of_a_lady", "snow_day")
EXTS = ("jpg", "JPG", "png", "txt", "heic", "pdf")
LEARNED = (("zonkle", "400", 3), ("quokka smile", "999", 1), ("beach photo", "700", 2))
#: code, parent, label, aliases, alias_of, active
EXTRA = (
    ("540", "500", "holidays", ("festivity", "vacations"), None, True), ("541", "540", "christmas", (), None, True), ("550", "500", "birthday", (), "540", False), ("560", "500", "xmas", (), "550", False),
    ("551", "550", "cakes", (), None, True), ("900~3", "900", "oddities", (), None, True), ("990", "900", "sundries", (), None, True), ("970", "900", "loop a", (), "980", False), ("980", "900", "loop b", (), "970", False),
)


def pick(index, values) -> object:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    name = F.concat(pick(i, STEMS), F.lit("_"), F.lpad(i.cast("string"), 12, "0"), F.lit("."), pick(i, EXTS))
    path = F.concat(F.lit("/src/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), name)
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), path.alias("source_path"), F.octet_length(text).cast("long").alias("size"), (F.lit(1700000000000000000) + i).alias("mtime_ns"), text.alias("content"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("doc_id", "lang", "source_path", "size", "mtime_ns", X.sha256_b64url(F.col("content")).alias("digest"))


def taxonomy(spark: SparkSession) -> DataFrame:
    extra = spark.createDataFrame([(c, p, label, f"{c}-{label.replace(' ', '-')}", list(a), to, on) for c, p, label, a, to, on in EXTRA], T.SCHEMA)
    return T.seed_taxonomy(spark).unionByName(extra)


def _part_code(p) -> object:
    taken = p.between(110, 999) & (p % 3 == 0) & (p % 10 != 0) & (F.floor(p / 10) % 10 != 0)
    return F.when(taken, p.cast("string")).otherwise(F.concat((p % 9 + 1).cast("string"), F.lit("00~"), p.cast("string")))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy that grows with ``part``: the spine, and a node per part below a class, some of them aliases of others."""
    p = F.col("p_partkey")
    code, alias = _part_code(p), (p % 10).isin(5, 6, 7)
    parent = F.when(code.contains("~"), F.concat((p % 9 + 1).cast("string"), F.lit("00"))).otherwise((F.floor(p / 10) * 10).cast("string"))
    none = F.array().cast("array<string>")
    nodes = read_table(spark, sf_dir, "part").select(
        code.alias("code"), parent.alias("parent_code"), F.col("p_name").alias("label"), F.concat_ws("-", code, X.slug(F.col("p_name"))).alias("folder_name"),
        F.when(p % 4 == 0, F.array("p_type")).otherwise(none).alias("aliases"), F.when(alias, _part_code(p - 1)).alias("alias_of"), (~alias).alias("active"),
    )
    return T.seed_taxonomy(spark).unionByName(nodes)


def url_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, parent_code, folder_name: every host part and path step of the pages' addresses, from the top domain down."""
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    steps = F.concat(F.reverse(F.split(F.substring_index(bare, "/", 1), r"\.")), F.slice(F.split(bare, "/"), 2, 1000))
    rows = read_table(spark, sf_dir, "pages").select(steps.alias("s")).select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i"))
    named = rows.select(F.array_join(F.slice("s", 1, F.col("i")), "/").alias("code"), F.when(F.col("i") > 1, F.array_join(F.slice("s", 1, F.col("i") - 1), "/")).alias("parent_code"), X.slug(F.element_at("s", F.col("i"))).alias("folder_name"))
    return named.distinct()


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, to: every event points to its user's event before; the first of some users points to a later one, a cycle."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_id").over(w).alias("to"), F.row_number().over(w).alias("n"))
    fifth = e.where("n = 5 AND user_id % 7 = 0").select("user_id", F.col("event_id").alias("fifth"), F.lit(1).alias("n"))
    return e.join(fifth, ["user_id", "n"], "left").select(F.col("event_id").alias("code"), F.coalesce("to", "fifth").alias("to"))


def learned(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEARNED), "subject string, class_code string, hits long")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read_table(spark, sf_dir, "part"), F.col("p_partkey")
    scene = F.when(k % 5 == 0, "at the beach").when(k % 5 == 1, "in a forest").otherwise("somewhere")
    return p.select(k.alias("pos"), F.translate(pick(k, STEMS), "_", " ").alias("primary_subject"), F.array(F.lower("p_type"), F.when(k % 7 == 0, "Dogs").otherwise("thing")).alias("objects"), scene.alias("scene"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cls = F.when(k % 4 == 0, "100").when(k % 4 == 1, "500").when(k % 4 == 2, "900").otherwise("zzz")
    label = F.when(k % 11 == 0, "none!").when(k % 13 == 0, "123").when(k % 17 == 0, "People").when(k % 19 == 0, "festivities").when(k % 23 == 0, "Birthdays").otherwise(F.concat(F.lit("Kind "), (k % 37).cast("string"), F.lit(" things")))
    return read_table(spark, sf_dir, "part").select(k.alias("pos"), cls.alias("class"), label.alias("label"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("/src/u"), F.col("user_id").cast("string")).alias("source_path"), (F.dayofmonth("ts") / 10).cast("int").cast("long").alias("size"), F.when(F.col("event_type") == "error", "error").otherwise("copied").alias("status"))


def seen(files: DataFrame) -> DataFrame:
    """Two of three files, some with another size, some with another time."""
    i = F.col("doc_id")
    return files.where(i % 3 != 0).select("source_path", F.when(i % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(i % 7 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"))


# --- the same in SQL ----------------------------------------------------------


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]::VARCHAR[]"


def sql_pick(index: str, values) -> str:
    return f"({listed(values)})[{index} % {len(values)} + 1]"


def sql_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def sql_descriptor(x: str) -> str:
    return f"coalesce(nullif(rtrim(left(array_to_string(({sql_words(x)})[1:3], '-'), 30), '-'), ''), 'photo')"


def sql_label(x: str) -> str:
    one = "CASE WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
    return f"coalesce(array_to_string(list_transform({sql_words(x)}, lambda w: {one}), ' '), '')"


def sql_slug(x: str) -> str:
    return f"coalesce(nullif(array_to_string({sql_words(x)}, '-'), ''), 'unnamed')"


def sql_digest(x: str) -> str:
    return f"translate(rtrim(to_base64(from_hex(sha256({x}))), '='), '+/', '-_')"


FILES = f"""files AS (
    SELECT doc_id, coalesce(lang, '') AS lang,
        '/src/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || {sql_pick("doc_id", STEMS)} || '_' || lpad(doc_id::VARCHAR, 12, '0') || '.' || {sql_pick("doc_id", EXTS)} AS source_path,
        strlen(coalesce(text, ''))::BIGINT AS size, 1700000000000000000 + doc_id AS mtime_ns, coalesce(text, '') AS content
    FROM documents)"""
DIGESTS = f"{FILES}, digests AS (SELECT doc_id, lang, source_path, size, mtime_ns, {sql_digest('content')} AS digest FROM files)"
SEEN = f"""{FILES}, seen AS (
    SELECT source_path, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 7 = 0 THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns
    FROM files WHERE doc_id % 3 <> 0)"""
_NODES = [(c, p, label, f"{c}-{label}", (), None, True) for c, p, label in C.seed_nodes()] + [(c, p, label, f"{c}-{label.replace(' ', '-')}", a, to, on) for c, p, label, a, to, on in EXTRA]
TAXONOMY = "taxonomy(code, parent_code, label, folder_name, aliases, alias_of, active) AS (VALUES " + ", ".join(f"({quoted(c)}, {quoted(p)}, {quoted(label)}, {quoted(folder)}, {listed(a)}, {quoted(to)}, {quoted(on)})" for c, p, label, folder, a, to, on in _NODES) + ")"
_SPINE = _NODES[: -len(EXTRA)]


def _sql_part_code(p: str) -> str:
    return f"CASE WHEN {p} BETWEEN 110 AND 999 AND {p} % 3 = 0 AND {p} % 10 <> 0 AND {p} // 10 % 10 <> 0 THEN ({p})::VARCHAR ELSE ({p} % 9 + 1) || '00~' || ({p}) END"


TREE = "spine(code, parent_code, label, folder_name, aliases, alias_of, active) AS (VALUES " + ", ".join(f"({quoted(c)}, {quoted(p)}, {quoted(label)}, {quoted(folder)}, {listed(a)}, {quoted(to)}, {quoted(on)})" for c, p, label, folder, a, to, on in _SPINE) + f"""),
    parted AS (SELECT *, {_sql_part_code("p_partkey")} AS code FROM part),
    taxonomy AS (SELECT code, parent_code, label, folder_name, aliases, alias_of::VARCHAR AS alias_of, active FROM spine UNION ALL SELECT code, CASE WHEN contains(code, '~') THEN (p_partkey % 9 + 1) || '00' ELSE (p_partkey // 10 * 10)::VARCHAR END, p_name, code || '-' || {sql_slug("p_name")}, CASE WHEN p_partkey % 4 = 0 THEN [p_type] ELSE []::VARCHAR[] END,
        CASE WHEN p_partkey % 10 IN (5, 6, 7) THEN {_sql_part_code("(p_partkey - 1)")} END, p_partkey % 10 NOT IN (5, 6, 7) FROM parted)"""
SPINE = TREE.split("),\n    parted AS", 1)[0] + "), taxonomy AS (SELECT code, parent_code, label, folder_name, aliases, alias_of::VARCHAR AS alias_of, active FROM spine)"
URL_NODES = f"""steps AS (SELECT list_concat(list_reverse(string_split(split_part(bare, '/', 1), '.')), string_split(bare, '/')[2:]) AS s FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS bare FROM pages)),
    nodes AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS code, CASE WHEN i > 1 THEN array_to_string(s[1:i - 1], '/') END AS parent_code, {sql_slug("s[i]")} AS folder_name FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM steps))"""
SEEDS = "seeds AS (SELECT subject, arg_min(class, rank) AS class FROM (SELECT " + sql_label("name") + " AS subject, class, rank FROM (VALUES " + ", ".join(
    [f"({quoted(label)}, {quoted(p)}, 0)" for _, p, label in C.seed_nodes() if p] + [f"({quoted(w)}, {quoted(code)}, 1)" for code, ws in C.SYNONYMS.items() for w in ws]
) + ") v(name, class, rank)) GROUP BY subject)"
LEARNED_SQL = "learned(subject, class_code, hits) AS (VALUES " + ", ".join(f"({quoted(s)}, {quoted(c)}, {h})" for s, c, h in LEARNED) + ")"
CONTENT = f"""content AS (
    SELECT p_partkey AS pos, replace({sql_pick("p_partkey", STEMS)}, '_', ' ') AS primary_subject, [lower(p_type), CASE WHEN p_partkey % 7 = 0 THEN 'Dogs' ELSE 'thing' END] AS objects,
        CASE p_partkey % 5 WHEN 0 THEN 'at the beach' WHEN 1 THEN 'in a forest' ELSE 'somewhere' END AS scene
    FROM part)"""
ITEMS = """items AS (
    SELECT p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN '100' WHEN 1 THEN '500' WHEN 2 THEN '900' ELSE 'zzz' END AS class,
        CASE WHEN p_partkey % 11 = 0 THEN 'none!' WHEN p_partkey % 13 = 0 THEN '123' WHEN p_partkey % 17 = 0 THEN 'People' WHEN p_partkey % 19 = 0 THEN 'festivities'
             WHEN p_partkey % 23 = 0 THEN 'Birthdays' ELSE 'Kind ' || (p_partkey % 37) || ' things' END AS label
    FROM part)"""
ATTEMPTS = """attempts AS (
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, '/src/u' || user_id AS source_path, (day(ts) // 10)::BIGINT AS size, CASE WHEN event_type = 'error' THEN 'error' ELSE 'copied' END AS status
    FROM events)"""
CLOSURE = """walk(code, cur, seen, depth) AS (
    SELECT code, code, []::VARCHAR[], 0 FROM taxonomy
    UNION ALL
    SELECT w.code, t.alias_of, list_append(w.seen, w.cur), w.depth + 1 FROM walk w JOIN taxonomy t ON t.code = w.cur
    WHERE t.alias_of IS NOT NULL AND NOT list_contains(w.seen, w.cur)),
closure AS (SELECT code, arg_max(cur, depth) AS target FROM walk GROUP BY code)"""
CLASSES = ", ".join(map(quoted, C.CLASSES))
DEGENERATE = "(" + " UNION ".join(f"SELECT {sql_label(quoted(x))}" for x in C.DEGENERATE) + ")"
