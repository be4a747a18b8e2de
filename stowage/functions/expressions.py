"""Scalar functions as column expressions; all stay inside the JVM.

ASCII digits and letters are meant wherever a pattern says so: Java's ``[0-9]`` rejects other digits. Patterns that a
line break may end use ``\\z``, as ``$`` also matches before other line terminators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions import constants as C

_CODE = r"\A[0-9]+(~[0-9]+)*\n?\z"
_RUNS = "[^a-z0-9]+"


# --- digests -----------------------------------------------------------------


def sha256_b64url(content: Column) -> Column:
    """SHA-256 as unpadded base64url: always 43 characters."""
    raw = F.base64(F.unhex(F.sha2(content, 256)))
    return F.translate(F.rtrim(raw, F.lit("=")), "+/", "-_")


def b64url_decode(encoded: Column) -> Column:
    plain = F.translate(encoded, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int"))))


def verify_digest(content: Column, expected: Column) -> Column:
    return sha256_b64url(content) == expected


def duplicate_path(folder: str, digest: Column, path: Column) -> Column:
    """Where a duplicate is put aside."""
    return F.concat(F.lit(f"{folder}/"), digest, F.lit("_"), base_name(path))


def quarantine_path(folder: str, path: Column) -> Column:
    """Where a file that failed too often is put aside."""
    return F.concat(F.lit(f"{folder}/"), quarantine_prefix(path), F.lit("_"), base_name(path))


def extract_digest(stem: Column) -> Column:
    """The digest in ``<code>-<descriptor>_<digest>``, found by counting back from the end; null where the form differs."""
    n = F.length(stem)
    prefix = F.substring(stem, F.lit(1), n - C.DIGEST_LENGTH - 1)
    dash = F.locate("-", prefix)
    code = F.substring(prefix, F.lit(1), dash - 1)
    ok = (n >= C.DIGEST_LENGTH + 4) & (F.substring(stem, n - C.DIGEST_LENGTH, F.lit(1)) == "_") & (dash > 0) & code.rlike(_CODE) & (F.length(prefix) > dash)
    return F.when(ok, F.substring(stem, n - C.DIGEST_LENGTH + 1, F.lit(C.DIGEST_LENGTH)))


def quarantine_prefix(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


# --- names ---------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_suffix(path: Column) -> Column:
    """With its dot; empty for names without one, that end in one, or whose only dots lead."""
    return F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]+)$", 1)


def path_stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(path_suffix(path)))


def extension(path: Column) -> Column:
    """Lower-cased, without the dot."""
    return F.lower(F.ltrim(path_suffix(path), F.lit(".")))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*C.EXTENSIONS)


def media_type(ext: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in C.MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, F.lower(ext)), F.lit("image/jpeg"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), _RUNS, " "), " "), lambda w: w != "")


def normalize_descriptor(text: Column) -> Column:
    joined = F.array_join(F.slice(_words(text), 1, C.DESCRIPTOR_WORDS), "-")
    return F.coalesce(F.nullif(F.rtrim(F.substring(joined, 1, C.DESCRIPTOR_LIMIT), F.lit("-")), F.lit("")), F.lit("photo"))


def normalize_label(text: Column) -> Column:
    """Lower case, runs of other characters as blanks, and a naive singular of every word."""
    def singular(w: Column) -> Column:
        n = F.length(w)
        return F.when((n > 4) & w.endswith("es"), F.substring(w, F.lit(1), n - 2)).when((n > 3) & w.endswith("s"), F.substring(w, F.lit(1), n - 1)).otherwise(w)

    return F.array_join(F.transform(_words(text), singular), " ")


def slug(label: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(_words(label), "-"), F.lit("")), F.lit("unnamed"))


def stub_words(stem: Column) -> Column:
    return F.filter(_words(stem), lambda w: F.length(w) > 1)


def clean_extension(ext: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(ext, ".", -1)), "[^a-z0-9]", "")


def generate_filename(code: Column, descriptor: Column, digest: Column, ext: Column) -> Column:
    """``<code>-<descriptor>_<digest>.<ext>`` of at most 100 characters: the descriptor gives way first, then the extension."""
    ext, desc = clean_extension(ext), normalize_descriptor(descriptor)
    fixed = F.length(code) + 2 + F.length(digest)
    tail = F.when(F.length(ext) > 0, F.length(ext) + 1).otherwise(0)
    room = F.greatest(F.lit(1), F.lit(C.NAME_LIMIT) - fixed - tail)
    cut = F.rtrim(F.substring(desc, F.lit(1), room), F.lit("-"))
    short = F.when(fixed + F.length(desc) + tail > C.NAME_LIMIT, F.coalesce(F.nullif(cut, F.lit("")), F.substring(desc, 1, 1))).otherwise(desc)
    over = F.greatest(F.lit(0), fixed + F.length(short) + tail - C.NAME_LIMIT)
    kept = F.substring(ext, F.lit(1), F.greatest(F.lit(0), F.length(ext) - over))
    return F.concat(code, F.lit("-"), short, F.lit("_"), digest, F.when(F.length(kept) > 0, F.concat(F.lit("."), kept)).otherwise(""))


def parse_filename(name: Column) -> Column:
    """struct(code, descriptor, digest, extension), or null."""
    stem = path_stem(name)
    digest = extract_digest(stem)
    prefix = F.substring(stem, F.lit(1), F.length(stem) - C.DIGEST_LENGTH - 1)
    dash = F.locate("-", prefix)
    return F.when(
        digest.isNotNull(),
        F.struct(F.substring(prefix, F.lit(1), dash - 1).alias("code"), F.substring(prefix, dash + 1, F.length(prefix)).alias("descriptor"), digest.alias("digest"), extension(name).alias("extension")),
    )


# --- classes, codes, labels -----------------------------------------------------


def is_class(code: Column) -> Column:
    return code.isin(*C.CLASSES)


def is_degenerate(label: Column) -> Column:
    norm = normalize_label(label)
    known = F.array(*(normalize_label(F.lit(x)) for x in C.DEGENERATE))
    return (norm == "") | F.array_contains(known, norm) | ~label.rlike(r"\p{L}")


def child_slots(code: Column) -> Column:
    """The nine integer codes below a top-level or second-level code; none below others."""
    base = code.try_cast("int")
    step = F.when(code.rlike(r"\A[1-9]00\n?\z"), 10).when(code.rlike(r"\A[1-9][1-9]0\n?\z"), 1)
    return F.when(step.isNotNull(), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: (base + step * k).cast("string"))).otherwise(F.array().cast("array<string>"))


def first_valid_code(answer: Column) -> Column:
    runs = F.regexp_extract_all(answer, F.lit("[0-9]+"), F.lit(0))
    return F.coalesce(F.get(F.filter(runs, lambda r: r.isin(*C.CLASSES)), F.lit(0)), F.lit(C.FALLBACK_CLASS))


def category_label(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for c, _, label in C.seed_nodes() for x in (c, label)))
    return F.try_element_at(names, code)


def resolve_code(code: Column) -> Column:
    """The code if the spine has it, else the fallback class."""
    return F.when(category_label(code).isNotNull(), code).otherwise(F.lit(C.FALLBACK_CLASS))


# --- numbers, JSON, lines -------------------------------------------------------


def rational(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / F.nullif(den, F.lit(0)))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def round7(x: Column) -> Column:
    return F.bround(x, 7)


def json_decode(raw: Column) -> Column:
    """A VARIANT, or null where the text is no JSON (the raw text stays in its own column)."""
    return F.try_parse_json(raw)


def json_encode(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def coerce_list(raw: Column) -> Column:
    """The items of a JSON array as texts; none where the text is something else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "array<string>"), F.array().cast("array<string>"))


def coerce_subject(subject: Column) -> Column:
    return F.coalesce(F.nullif(subject, F.lit("")), F.lit("photo"))


def list_line(digest: Column, code: Column, path: Column) -> Column:
    return F.concat(F.substring(digest, 1, 12), F.lit("…  "), F.when(F.length(code) < 5, F.lpad(code, 5, " ")).otherwise(code), F.lit("  "), F.coalesce(path, F.lit("None")))
