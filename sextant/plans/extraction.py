"""Queries of the extractors, sources and writers, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions.tables import spread
from sextant.operators import extract
from sextant.plans import store


def _pages(s, d):
    p = spread(store.table(s, d, "pages"), "page_id")
    return p.select(F.col("url").alias("path"), F.lit("text/html").alias("mime"), F.encode(F.col("html"), "UTF-8").alias("content"), "page_id")


def e_html(s, d):
    found = extract.extract(_pages(s, d))
    return found.select("path", "graph", F.element_at("rdf_types", 1).alias("class"), F.element_at("props", "nie:title").alias("title"), "error")


def e_text(s, d):
    docs = spread(store.elements(s, d), "doc_id")
    found = extract.extract(docs.select(F.col("url").alias("path"), F.lit("text/plain").alias("mime"), F.encode("text", "UTF-8").alias("content")))
    return found.select("path", "graph", F.md5("text").alias("digest"))


def e_errors(s, d):
    docs = spread(store.elements(s, d), "doc_id")
    mime = F.element_at(F.array(F.lit("image/png"), F.lit("application/epub+zip"), F.lit("image/jpeg")), F.col("sn") % 3 + 1)
    found = extract.extract(docs.select(F.col("url").alias("path"), mime.alias("mime"), F.encode("text", "UTF-8").alias("content")))
    return found.where("error IS NOT NULL").select("path", "mime", "graph", "error")


def _playlists(s, d):
    x = spread(store.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey")
    line = F.concat(F.lit("#EXTINF:"), F.col("l_quantity").cast("long").cast("string"), F.lit(",x\nhttp://m/"), F.col("l_partkey").cast("string"))
    rows = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("e"))
    return rows.select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("#EXTM3U\n"), F.array_join("e.line", "\n"), F.lit("\n")).alias("text"))


def e_playlist(s, d):
    return extract.playlist_entries(_playlists(s, d))


def e_playlist_summary(s, d):
    return extract.playlist_summary(_playlists(s, d))


def k21_write_pls(s, d):
    return extract.write_pls(extract.playlist_entries(_playlists(s, d))).select("path", F.md5("text").alias("digest"))


def k21_write_m3u(s, d):
    return extract.write_m3u(extract.playlist_entries(_playlists(s, d))).select("path", F.md5("text").alias("digest"))


def k21_write_xspf(s, d):
    return extract.write_xspf(extract.playlist_entries(_playlists(s, d))).select("path", F.md5("text").alias("digest"))


def _sheets(s, d):
    x = spread(store.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    at = F.col("l_linenumber") * 200 + F.col("l_partkey") % 100
    index = F.format_string("%02d:%02d:%02d", F.floor(at / 60).cast("int"), (at % 60).cast("int"), (F.col("l_partkey") % 75).cast("int"))
    line = F.concat(F.format_string('  TRACK %02d AUDIO\n    TITLE "t', F.col("l_linenumber")), F.col("l_partkey").cast("string"), F.lit('"\n    INDEX 01 '), index)
    rows = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("e"))
    return rows.select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit('FILE "a.flac" WAVE\n'), F.array_join("e.line", "\n"), F.lit("\n")).alias("text"))


def e_cue(s, d):
    return extract.cue_tracks(_sheets(s, d)).select("path", F.col("track").cast("long").alias("track"), "title", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


def e_bmp(s, d):
    little = lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    o = store.table(s, d, "orders")
    content = F.unhex(F.concat(F.lit("424D"), F.lit("00" * 16), little(F.col("o_orderkey")), little(F.col("o_custkey"))))
    return o.select("o_orderkey", extract.bitmap_size(content).alias("b")).select("o_orderkey", F.col("b.width").alias("width"), F.col("b.height").alias("height"))


def _big(c, size):
    return F.lpad(F.hex(c), 2 * size, "0")


def e_tiff(s, d):
    little = lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    entry = lambda tag, kind, c: F.concat(F.lit(tag + kind + "01000000"), little(c))
    o = spread(store.table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    entries = [entry("0001", "0400", F.col("o_orderkey")), entry("0101", "0400", F.col("o_custkey")), entry("1201", "0300", F.col("o_orderkey") % 10)]
    content = F.unhex(F.concat(F.lit("49492A00080000000300"), *entries, F.lit("00000000")))
    found = extract.extract(o.select(F.col("o_orderkey").cast("string").alias("path"), F.lit("image/tiff").alias("mime"), content.alias("content")))
    p = lambda k: F.element_at("props", k)
    return found.select("path", p("nfo:width").cast("long").alias("width"), p("nfo:height").cast("long").alias("height"), p("nfo:orientation").alias("orientation"), "error")


def e_mp3(s, d):
    first = F.concat(F.lit("FFFB9000" + "00" * 32 + b"Xing".hex() + "00000001"), _big(F.col("c_custkey") * 100, 4), F.lit("00" * 369))
    tail = F.concat(F.lit(b"TAG".hex() + "00" * 124), _big(F.col("c_nationkey"), 1))
    content = F.unhex(F.concat(first, F.lit("FFFB9000" + "00" * 413), tail))
    found = extract.extract(spread(store.table(s, d, "customer"), "c_custkey").select(F.col("c_name").alias("path"), F.lit("audio/mpeg").alias("mime"), content.alias("content")))
    p = lambda k: F.element_at("props", k)
    return found.select("path", p("nfo:duration").cast("long").alias("seconds"), p("nfo:averageBitrate").cast("long").alias("bits"), p("nfo:sampleRate").cast("long").alias("hertz"), p("nfo:genre").alias("genre"), p("nmm:dlnaProfile").alias("profile"), "error")


def e_iptc(s, d):
    value = lambda tag, c: F.concat(F.lit("1C02" + tag), _big(F.octet_length(c), 2), F.hex(c))
    c = spread(store.table(s, d, "customer"), "c_custkey")
    data = F.concat(value("50", F.col("c_name")), value("19", F.col("c_mktsegment")), value("19", F.lit("city")), value("37", F.lit("20070415")), value("83", F.when(F.col("c_nationkey") % 2 == 0, "P").otherwise("L")))
    size = lambda h: F.length(h) / 2
    body = F.concat(F.lit(b"Photoshop 3.0\0".hex() + b"8BIM".hex() + "04040000"), _big(size(data).cast("long"), 4), data)
    content = F.unhex(F.concat(F.lit("FFD8FFED"), _big(size(body).cast("long") + 2, 2), body))
    found = extract.extract(c.select(F.col("c_name").alias("path"), F.lit("image/jpeg").alias("mime"), content.alias("content")))
    p = lambda k: F.element_at("props", k)
    return found.select("path", p("nco:creator").alias("creator"), p("nie:keyword").alias("keywords"), p("nie:contentCreated").alias("created"), p("nfo:orientation").alias("orientation"), "error")


def a17_cue_track_count(s, d):
    return extract.cue_track_count(_sheets(s, d))


QUERIES = {f.__name__: f for f in (a17_cue_track_count, e_tiff, e_mp3, e_iptc, e_html, e_text, e_errors, e_playlist, e_playlist_summary, k21_write_pls, k21_write_m3u, k21_write_xspf, e_cue, e_bmp)}

_LISTS = "x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_partkey FROM lineitem)"
SQL = {
    "e_html": """SELECT url AS path, 'Documents' AS graph, 'nfo:HtmlDocument' AS class, trim(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&')) AS title, NULL AS error FROM pages""",
    "e_text": "SELECT 'file:///' || source || '/' || doc_id || '.txt' AS path, 'Documents' AS graph, md5(text) AS digest FROM documents",
    "e_errors": """SELECT path, mime, CASE mime WHEN 'application/epub+zip' THEN 'Documents' ELSE 'Pictures' END AS graph,
        CASE mime WHEN 'image/png' THEN 'ValueError: not a PNG file' WHEN 'image/jpeg' THEN 'ValueError: not a JPEG file' ELSE 'BadZipFile: File is not a zip file' END AS error FROM (
        SELECT 'file:///' || source || '/' || doc_id || '.txt' AS path, (['image/png', 'application/epub+zip', 'image/jpeg'])[CAST(substr(source, 4) AS INT) % 3 + 1] AS mime FROM documents)""",
    "e_playlist": f"WITH {_LISTS} SELECT CAST(l_orderkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, q) AS position, 'http://m/' || l_partkey AS url FROM x",
    "e_playlist_summary": f"WITH {_LISTS} SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) AS entries, CAST(sum(q) AS BIGINT) AS seconds FROM x GROUP BY 1",
    "k21_write_pls": f"""WITH {_LISTS}, y AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM x)
        SELECT CAST(l_orderkey AS VARCHAR) AS path, md5('[playlist]' || chr(10) || string_agg('File' || p || '=http://m/' || l_partkey, chr(10) ORDER BY p) || chr(10) || 'NumberOfEntries=' || count(*) || chr(10) || 'Version=2' || chr(10)) AS digest FROM y GROUP BY l_orderkey""",
    "k21_write_m3u": f"""WITH {_LISTS} SELECT CAST(l_orderkey AS VARCHAR) AS path, md5('#EXTM3U' || chr(10) || string_agg('http://m/' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) || chr(10)) AS digest FROM x GROUP BY l_orderkey""",
    "k21_write_xspf": f"""WITH {_LISTS} SELECT CAST(l_orderkey AS VARCHAR) AS path, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<playlist version="1" xmlns="http://xspf.org/ns/0/">' || chr(10) || '<trackList>' || chr(10)
        || string_agg('<track><location>http://m/' || l_partkey || '</location></track>' || chr(10), '' ORDER BY l_linenumber, l_partkey) || '</trackList>' || chr(10) || '</playlist>' || chr(10)) AS digest FROM x GROUP BY l_orderkey""",
    "e_cue": f"""WITH {_LISTS}, y AS (SELECT l_orderkey, l_partkey, row_number() OVER w AS track, l_linenumber * 200 + l_partkey % 100 + (l_partkey % 75) / 75.0 AS start FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))
        SELECT CAST(l_orderkey AS VARCHAR) AS path, track, 't' || l_partkey AS title, round(start, 6) AS start, round(lead(start) OVER (PARTITION BY l_orderkey ORDER BY track) - start, 6) AS duration FROM y""",
    "a17_cue_track_count": "SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) AS tracks FROM lineitem GROUP BY 1",
    "e_tiff": """SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS width, o_custkey AS height, NULL AS error,
        'nfo:orientation-' || coalesce((['top', 'top-mirror', 'bottom-mirror', 'bottom', 'left-mirror', 'right', 'right-mirror', 'left'])[CAST(o_orderkey % 10 AS INT)], 'top') AS orientation FROM orders""",
    "e_mp3": """SELECT c_name AS path, c_custkey * 100 * 1152 // 44100 AS seconds, CAST(128000 AS BIGINT) AS bits, CAST(44100 AS BIGINT) AS hertz, 'MP3' AS profile, NULL AS error,
        (['Blues', 'Classic Rock', 'Country', 'Dance', 'Disco', 'Funk', 'Grunge', 'Hip-Hop', 'Jazz', 'Metal', 'New Age', 'Oldies', 'Other', 'Pop', 'R&B', 'Rap', 'Reggae', 'Rock', 'Techno', 'Industrial', 'Alternative', 'Ska', 'Death Metal', 'Pranks', 'Soundtrack'])[CAST(c_nationkey AS INT) + 1] AS genre FROM customer""",
    "e_iptc": """SELECT c_name AS path, c_name AS creator, c_mktsegment || ', city' AS keywords, '2007-04-15T00:00:00' AS created, NULL AS error,
        CASE WHEN c_nationkey % 2 = 0 THEN 'nfo:orientation-left' ELSE 'nfo:orientation-top' END AS orientation FROM customer""",
    "e_bmp": "SELECT o_orderkey, o_orderkey AS width, o_custkey AS height FROM orders",
}
