"""Every query of the catalog against its oracle SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from sextant.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLE:
        assert rows
        return
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall())


def test_all_artists(spark, tmp_path):
    """More artists than one page of a search has."""
    spark.range(700).selectExpr("id AS s_suppkey", "concat('Supplier#', id) AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    assert catalog.queries()["q5_artists"](spark, str(tmp_path)).count() == 700


DEALT = "e_png_ranks e_tiff_ranks e_jpeg_ranks e_iptc e_xmp_regions e_open_document e_charsets e_desktop k21_write_images k21_write_audio e_tiff fts_stemmed e_ps e_abiword e_mp3 e_icon e_playlist_summary e_html e_text".split()


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt(spark, name):
    """Queries that take long for each row deal them over tasks, however few tasks read the file."""
    plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_events_of_a_hot_folder_are_dealt(spark):
    plan = catalog.queries()["d8_purge"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan and plan.count("Join ") == 2
