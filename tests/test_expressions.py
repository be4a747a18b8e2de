"""Expressions against plain Python written for these tests."""

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stowage.functions import expressions as X

TEXTS = ["", "Hello World", "Beaches!", "wines & wins", "--a--b--", "ein Café", "none", "a b c d e", "x" * 50, "Holidays 2020", "UPPER_case-Mix", "ss es ies", "été", "one two" + "o" * 40]


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, column):
    return [r[0] for r in df.select("i", column.alias("y")).orderBy("i").select("y").collect()]


def py_words(t):
    return [w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split(" ") if w]


def py_descriptor(t):
    return "-".join(py_words(t)[:3])[:30].rstrip("-") or "photo"


def py_label(t):
    return " ".join(w[:-2] if len(w) > 4 and w.endswith("es") else w[:-1] if len(w) > 3 and w.endswith("s") else w for w in py_words(t))


def test_text_functions(spark):
    df = frame(spark, TEXTS)
    assert values(df, X.normalize_descriptor(F.col("x"))) == [py_descriptor(t) for t in TEXTS]
    assert values(df, X.normalize_label(F.col("x"))) == [py_label(t) for t in TEXTS]
    assert values(df, X.slug(F.col("x"))) == ["-".join(py_words(t)) or "unnamed" for t in TEXTS]
    assert values(df, X.sha256_b64url(F.col("x"))) == [base64.urlsafe_b64encode(hashlib.sha256(t.encode()).digest()).decode().rstrip("=") for t in TEXTS]


def test_digest_round_trip(spark):
    df = frame(spark, TEXTS)
    assert values(df, X.b64url_decode(X.sha256_b64url(F.col("x")))) == [hashlib.sha256(t.encode()).digest() for t in TEXTS]


D = "A" * 43
U = "A" * 21 + "_" + "B" * 21


@pytest.mark.parametrize(
    ("stem", "digest"),
    [
        (f"330-beach_{D}", D), (f"540~1-a-b_{U}", U), (f"330-_{D}", None), (f"330_{D}", None), (f"abc-x_{D}", None), (f"+330-x_{D}", None), (f"540.1-x_{D}", None),
        (f"٣٣٠-x_{D}", None), (f"-x_{D}", None), (D, None), ("", None), (f"1-x_{D[:-1]}", None), (f"330~-x_{D}", None),
    ],
)
def test_extract_digest(spark, stem, digest):
    assert values(frame(spark, [stem]), X.extract_digest(F.col("x"))) == [digest]


def test_names_never_exceed_the_limit(spark):
    rows = [(i, c, d, e) for i, (c, d, e) in enumerate((c, d, e) for c in ("330", "540~12") for d in ("", "beach photo", "a" * 80, "x y") for e in ("", "jpg", "tar.gz", "J?P:G", "x" * 25, "y" * 60, "."))]
    df = spark.createDataFrame(rows, "i int, c string, d string, e string")
    made = values(df, X.generate_filename(F.col("c"), F.col("d"), F.lit(D), F.col("e")))
    for (_, c, d, e), name in zip(rows, made, strict=True):
        ext = re.sub("[^a-z0-9]", "", e.lower().rsplit(".", 1)[-1])
        want = f"{c}-{py_descriptor(d)}_{D}" + (f".{ext}" if ext else "")
        assert len(name) <= 100 and name.startswith(f"{c}-") and f"_{D}" in name
        if len(want) <= 100:
            assert name == want
    parsed = [r[0] for r in df.select("i", X.parse_filename(X.generate_filename(F.col("c"), F.col("d"), F.lit(D), F.col("e"))).alias("p")).orderBy("i").select("p.digest").collect()]
    assert set(parsed) == {D}


def test_paths(spark):
    paths = ["/a/b.jpg", "/a.b/c", "c.tar.gz", "/x/.hidden", "/x/.hidden.jpg", "/x/end.", "SHOUT.JPG", "/x/a b.c.Png"]
    from pathlib import PurePosixPath

    df = frame(spark, paths)
    assert values(df, X.path_stem(F.col("x"))) == [PurePosixPath(p).stem if not p.endswith(".") else "end." for p in paths]
    assert values(df, X.extension(F.col("x"))) == ["jpg", "", "gz", "", "jpg", "", "jpg", "png"]
    assert values(df, X.is_supported(F.col("x"))) == [True, False, False, False, True, False, True, True]


def test_codes_and_numbers(spark):
    assert values(frame(spark, ["500", "540", "541", "540~1", "900", "5x0"]), F.array_join(X.child_slots(F.col("x")), " ")) == [" ".join(str(500 + 10 * k) for k in range(1, 10)), " ".join(str(540 + k) for k in range(1, 10)), "", "", " ".join(str(900 + 10 * k) for k in range(1, 10)), ""]
    assert values(frame(spark, ["class 500", "5000 or 300", "none", "999 100"]), X.first_valid_code(F.col("x"))) == ["500", "300", "900", "100"]
    assert values(frame(spark, ["none!", "N/A", "", "123", "!!!", "misc.", "dog", "Unlabelled"]), X.is_degenerate(F.col("x"))) == [True, True, True, True, True, True, False, True]
    one = spark.range(1)
    assert one.select(X.dms_to_decimal(F.lit(10.0), F.lit(30.0), F.lit(36.0), F.lit("s"))).first()[0] == pytest.approx(-10.51)
    assert one.select(X.rational(F.lit(1), F.lit(0)), X.rational(F.lit(3), F.lit(4))).first() == (0.0, 0.75)
    assert one.select(X.list_line(F.lit(D), F.lit("33"), F.lit(None).cast("string"))).first()[0] == "A" * 12 + "…     33  None"
    assert one.select(X.json_decode(F.lit("{broken")).isNull(), X.media_type(F.lit("png")), X.media_type(F.lit("nef"))).first() == (True, "image/png", "image/jpeg")
