import pytest
from pyspark.sql import functions as F

from sextant.functions import dates, media, paths, strings


def value(spark, column, **columns):
    names = list(columns) or ["x"]
    types = ", ".join(f"`{n}` {'int' if isinstance(columns.get(n), int) else 'double' if isinstance(columns.get(n), float) else 'binary' if isinstance(columns.get(n), bytes) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(columns.get(n) for n in names)], types).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", None), ("20", None), ("2008", "2008-01-01T00:00:00Z"), ("0000", None), ("2008-06-14", "2008-06-14T00:00:00"), ("20080614000000", "2008-06-14T00:00:00"), ("20080614000000Z", "2008-06-14T00:00:00Z"),
        ("Mon Jun 14 04:20:20 2008", "2008-06-14T04:20:20"), ("2008:06:14 04:20:20", "2008-06-14T04:20:20"), ("2010-03-18T01:02:03Z", "2010-03-18T01:02:03Z"), ("20100318010203+02'00'", "2010-03-18T01:02:03+02:00"), ("no date at all", None),
    ],
)
def test_date_guess(spark, text, expected):
    assert value(spark, dates.guess(F.col("x")), x=text) == expected


def test_date_parse(spark):
    ms = lambda t: value(spark, dates.parse(F.col("x"))["ms"], x=t)
    assert ms("1970-01-01T00:00:01Z") == 1000
    assert ms("1970-01-01T02:00:00+02:00") == 0
    assert ms("1970-01-01T00:00:00.250Z") == 250
    assert ms("1970-01-01T00:00:00+15:00") is None
    assert ms("1970-13-01") is None


def test_strings(spark):
    assert value(spark, strings.coalesce_strip(F.col("a"), F.col("b")), a="  ", b=" x ") == "x"
    assert value(spark, strings.merge("*", F.col("a"), F.col("b")), a="a", b="b") == "a*b"
    assert value(spark, strings.merge("*", F.col("a"), F.col("b")), a=None, b=None) is None
    assert value(spark, strings.keywords(F.col("x")), x='say "a, b;c, a"') == ["a", "b", "c"]
    assert value(spark, strings.truncate(F.col("x"), 5), x="abcdefgh") == "ab[…]"
    assert value(spark, strings.hex_pairs(F.col("x")), x=b"\x01\xff") == "01:FF"
    assert value(spark, strings.title_of(F.col("x")), x="my_song.mp3") == "my song"
    assert value(spark, strings.title_of(F.col("x")), x=".profile") == " .profile".strip()
    assert value(spark, strings.extension_changed(F.col("a"), F.col("b")), a="x.mp3", b="x.ogg") is True
    assert value(spark, strings.normalize(F.col("x"), 1), x="one, 2 two three") == "one two"


def test_search_words(spark):
    words = lambda t: value(spark, strings.tokens(F.col("x")), x=t)
    assert "unlimited" in words("automobile with unlimited power")
    assert words("x" * 400) == []
    assert "abc123" in words("abc123")
    assert words("Élan vital") == ["elan", "vital"]


def test_media(spark):
    assert value(spark, media.gps_decimal(F.col("d"), F.col("m"), F.col("s"), F.lit("S")), d=35.0, m=15.0, s=12.126) == pytest.approx(-35.2533683, abs=1e-5)
    assert value(spark, media.rational(F.col("x")), x="1/0") is None
    assert value(spark, media.rational(F.col("x")), x="1/4") == 0.25
    assert value(spark, media.exposure(F.col("x")), x="1/8") == 0.125
    assert value(spark, media.synchsafe(F.col("x")), x=b"\x00\x00\x02\x01") == 257


def test_image_values(spark):
    assert value(spark, media.gps_text(F.col("x")), x="35,15.5S") == pytest.approx(-35.258333)
    assert value(spark, media.gps_text(F.col("x")), x="nowhere") is None
    assert value(spark, media.fnumber(F.col("x")), x="f/5.6") == "5.6"
    assert value(spark, media.flash(F.col("x")), x=9) == "nmm:flash-on" and value(spark, media.flash(F.col("x")), x=16) == "nmm:flash-off"
    assert value(spark, media.metering(F.col("x")), x=77) == "nmm:metering-mode-other"
    assert value(spark, media.region_type(F.col("x")), x="FaceOne") == "nfo:roi-content-face"


@pytest.mark.parametrize(
    ("text", "expected"),
    [("(18:07 Tuesday 22 May 2007)", "2007-05-22T18:07:00+0000"), ("Tue May 22 18:07:10 2007", "2007-05-22T18:07:10+0000"), ("22 May 1997 18:07:10 -0600", "1997-05-22T18:07:10-0600"), ("6:07 PM May 22, 2007", "2007-05-22T18:07:00+0000"), ("12:07 AM May 2, 2007", "2007-05-02T00:07:00+0000"), ("soon", None)],
)
def test_page_description_dates(spark, text, expected):
    assert value(spark, dates.page_description(F.col("x")), x=text) == expected


def test_globs(spark):
    assert value(spark, F.col("x").rlike(paths.glob_regex("*.t?t")), x="a.txt") is True
    assert value(spark, F.col("x").rlike(paths.glob_regex("[a]*")), x="a") is False
    assert value(spark, F.rlike(F.col("x"), paths.glob_column(F.col("g"))), x="a.b+c", g="a.?+*") is True
    assert value(spark, paths.is_under(F.col("x"), F.lit("/a/b")), x="/a/bc") is False


def test_marks_words_and_snippets(spark):
    row = spark.createDataFrame([("Ệrable Łódź e\u0301t the Éclair of the OTHER thé",)], "t string").select(
        strings.unaccent(F.col("t")).alias("u"), strings.tokens(F.col("t"), stop=["the"]).alias("w"), strings.snippet(F.col("t"), ["éclair", "zzz"], before=3, length=9).alias("s"), strings.snippet(F.col("t"), ["he"], before=0, length=4).alias("n")
    ).first()
    assert row.u == "erable łodz et the eclair of the other the"
    assert row.w == ["erable", "łodz", "et", "eclair", "of", "other"]
    assert "Éclair"[:3] in row.s and row.n == "Ệrab"  # not inside other words
