"""Queries of image metadata: files with EXIF, IPTC and XMP at once, and regions, built of the driver's rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from sextant.functions.tables import map_batches, spread
from sextant.operators import extract, writers
from sextant.plans import store

NAMESPACES = 'xmlns:x="adobe:ns:meta/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:exif="http://ns.adobe.com/exif/1.0/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" xmlns:tiff="http://ns.adobe.com/tiff/1.0/" xmlns:mwg-rs="http://www.metadataworkinggroup.com/schemas/regions/" xmlns:stArea="http://ns.adobe.com/xmp/sType/Area#"'


def packet(inner: str) -> bytes:
    return f'<x:xmpmeta {NAMESPACES}><rdf:RDF><rdf:Description rdf:about="">{inner}</rdf:Description></rdf:RDF></x:xmpmeta>'.encode()


def directory(entries: list[tuple[int, int, bytes]]) -> bytes:
    """A TIFF file of one directory of (tag, type, bytes)."""
    sizes, heap, rows = {2: 1, 3: 2, 4: 4, 7: 1}, b"", b""
    start = 8 + 2 + 12 * len(entries) + 4
    for tag, kind, value in sorted(entries):
        place = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", start + len(heap))
        rows += struct.pack("<HHI", tag, kind, len(value) // sizes[kind]) + place
        heap += value if len(value) > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + rows + b"\0" * 4 + heap


def datasets(values: list[tuple[int, bytes]]) -> bytes:
    return b"".join(struct.pack(">BBBH", 0x1C, 2, tag, len(v)) + v for tag, v in values)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def build(form: str, k: int, name: str, segment: str, nation: int) -> bytes:
    """An image in which XMP, EXIF, IPTC and the format's own texts say different things; which of them say anything depends on k."""
    xmp = "".join(
        text
        for there, text in (
            (k % 2 == 0, f'<dc:title><rdf:Alt><rdf:li xml:lang="de">Titel</rdf:li><rdf:li xml:lang="x-default">{name}</rdf:li></rdf:Alt></dc:title>'),
            (k % 3 == 0, f"<dc:rights>rights {nation}</dc:rights>"),
            (k % 5 == 0, f"<exif:Copyright>copyright {nation}</exif:Copyright>"),
            (k % 7 == 0, f"<pdf:Title>pdf {nation}</pdf:Title>"),
            (k % 4 == 0, f"<tiff:Orientation>{nation % 10}</tiff:Orientation><exif:Flash rdf:parseType='Resource'><exif:Fired>True</exif:Fired></exif:Flash>"),
            (k % 6 == 0, f"<exif:GPSLatitude>{nation},30.5S</exif:GPSLatitude><exif:ISOSpeedRatings><rdf:Seq><rdf:li>{100 * (nation + 1)}</rdf:li></rdf:Seq></exif:ISOSpeedRatings>"),
        )
        if there
    )
    x, text = packet(xmp), lambda s: s.encode() + b"\0"
    exif = [(0x010D, 2, text(f"document {nation}")), (0x8298, 2, text(f"camera {nation}")), (0x0112, 3, struct.pack("<H", 6)), (0x8827, 3, struct.pack("<H", 50))]
    iptc = datasets([(116, b"agency"), (80, segment.encode()), (25, b"one"), (25, b"two")])
    if form == "tiff":
        return directory([*exif, (0x0100, 4, struct.pack("<I", k)), (0x0101, 4, struct.pack("<I", 9)), (0x83BB, 7, iptc), (0x02BC, 7, x)])
    if form == "jpeg":
        mark = lambda code, body: b"\xff" + bytes([code]) + struct.pack(">H", len(body) + 2) + body
        resource = b"Photoshop 3.0\x008BIM\x04\x04\0\0" + struct.pack(">I", len(iptc)) + iptc
        frame = mark(0xC0, struct.pack(">BHHB", 8, 9, k % 60_000, 1))
        return b"\xff\xd8" + mark(0xE1, b"Exif\0\0" + directory(exif)) + mark(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + x) + mark(0xED, resource) + frame
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", k, 9, 8, 2, 0, 0, 0)), chunk(b"eXIf", directory(exif))]
    parts.append(chunk(b"iTXt", b"XML:com.adobe.xmp\0\1\0\0\0" + zlib.compress(x)))
    if k % 8 == 1:
        parts.append(chunk(b"zTXt", b"Title\0\0" + zlib.compress(f"own {nation}".encode())))
    parts.append(chunk(b"tEXt", b"Creation Time\0Tue, 02 Jan 2007 03:04:05 -0300"))
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts) + chunk(b"IEND", b"")


def _files(s, d, form: str):
    c = spread(store.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[x.to_pylist() for x in batch.columns], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in rows], pa.string()), pa.array([f"image/{form}"] * len(rows), pa.string()), pa.array([build(form, *r) for r in rows], pa.binary())], names=["path", "mime", "content"])

    return map_batches(c, run, "path string, mime string, content binary")


def _ranked(form: str):
    def query(s, d):
        found = extract.extract(_files(s, d, form))
        p = lambda k: F.element_at("props", k)
        return found.select(
            F.col("path").cast("long").alias("k"), p("nie:title").alias("title"), p("nie:copyright").alias("copyright"), p("nfo:orientation").alias("orientation"), p("nmm:flash").alias("flash"), p("nmm:isoSpeed").alias("iso"),
            F.round(p("slo:latitude").cast("double"), 6).alias("latitude"), p("nco:creator").alias("creator"), p("nie:keyword").alias("keywords"), p("nie:contentCreated").alias("created"), p("nfo:width").cast("long").alias("width"), "error",
        )

    return query


def xmp_regions(s, d):
    """Regions of packets with as many as the part's size says, nested lists and structures."""
    area = lambda k: F.concat(F.lit("<rdf:li rdf:parseType='Resource'><mwg-rs:Name>"), F.col("p_brand"), F.lit(" "), k.cast("string"), F.lit("</mwg-rs:Name><mwg-rs:Type>"), F.when(k % 2 == 0, "Face").otherwise("Thing"), F.lit("</mwg-rs:Type><mwg-rs:Area stArea:x='0."), F.col("p_size").cast("string"), F.lit("' stArea:y='0.5' stArea:w='0.1'/></rdf:li>"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), area), "")
    head, tail = packet("<mwg-rs:Regions rdf:parseType='Resource'><mwg-rs:RegionList><rdf:Bag>|</rdf:Bag></mwg-rs:RegionList></mwg-rs:Regions>").decode().split("|")
    content = F.encode(F.concat(F.lit("image bytes "), F.lit(head), items, F.lit(tail), F.lit(" more")), "UTF-8")
    files = spread(store.table(s, d, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return extract.image_regions(files).select(F.col("path").cast("long").alias("p_partkey"), "region", "title", "type", "x", "y", "width", "height")


_NAMES = "(['top', 'top-mirror', 'bottom', 'bottom-mirror', 'left-mirror', 'right', 'right-mirror', 'left'])"


def _expected(title: str, rights: str, creator: str, keywords: str, created: str, width: str = "k", latitude: str = "round(-(n + 30.5::DOUBLE / 60), 6)") -> str:
    return f"""SELECT k, {title} AS title, {rights} AS copyright, 'nfo:orientation-' || CASE WHEN k % 4 = 0 THEN coalesce({_NAMES}[n % 10], 'top') ELSE 'right' END AS orientation, CASE WHEN k % 4 = 0 THEN 'nmm:flash-on' END AS flash,
        CASE WHEN k % 6 = 0 THEN CAST(100 * (n + 1) AS VARCHAR) ELSE '50' END AS iso, CASE WHEN k % 6 = 0 THEN {latitude} END AS latitude, {creator} AS creator, {keywords} AS keywords, {created} AS created, {width} AS width, NULL AS error
        FROM (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_nationkey AS n FROM customer)"""


_RIGHTS = "CASE WHEN k % 3 = 0 THEN 'rights ' || n ELSE 'camera ' || n END"
QUERIES = {"e_jpeg_ranks": _ranked("jpeg"), "e_tiff_ranks": _ranked("tiff"), "e_png_ranks": _ranked("png"), "e_xmp_regions": xmp_regions}
SQL = {
    "e_jpeg_ranks": _expected("CASE WHEN k % 2 = 0 THEN name ELSE 'document ' || n END", "CASE WHEN k % 5 = 0 THEN 'copyright ' || n WHEN k % 3 = 0 THEN 'rights ' || n ELSE 'camera ' || n END", "segment", "'one, two'", "NULL", "k % 60000"),
    "e_tiff_ranks": _expected("CASE WHEN k % 2 = 0 THEN name WHEN k % 7 = 0 THEN 'pdf ' || n ELSE 'document ' || n END", _RIGHTS, "segment", "'one, two'", "NULL"),
    "e_png_ranks": _expected("CASE WHEN k % 2 = 0 THEN name WHEN k % 8 = 1 THEN 'own ' || n ELSE 'document ' || n END", _RIGHTS, "NULL", "NULL", "'2007-01-02T03:04:05-0300'", latitude="NULL::DOUBLE"),
    "e_xmp_regions": """SELECT p_partkey, r AS region, p_brand || ' ' || r AS title, CASE WHEN r % 2 = 0 THEN 'nfo:roi-content-face' ELSE 'nfo:roi-content-undefined' END AS type, '0.' || p_size AS x, '0.5' AS y, '0.1' AS width, NULL AS height
        FROM (SELECT p_partkey, p_brand, p_size, unnest(range(1, p_size % 4 + 2)) AS r FROM part)""",
}


def _props(names: dict):
    """A map of the properties that have a value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in names.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def k21_write_images(s, d):
    """Images of three formats, written and read again."""
    n = F.col("c_nationkey")
    values = _props({
        "nie:title": F.concat(F.lit("neu & <"), F.col("c_name"), F.lit(">")), "nie:copyright": F.col("c_mktsegment"), "nie:keyword": F.concat(F.lit("a,"), F.col("c_mktsegment")), "nfo:orientation": F.lit("nfo:orientation-bottom"),
        "nmm:flash": F.when(n % 2 == 0, "nmm:flash-on").otherwise("nmm:flash-off"), "slo:latitude": F.when(n % 3 == 0, (n - F.lit(12)).cast("string")), "nie:description": F.when(n % 5 == 0, F.lit("")),
    })
    c = store.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), values.alias("props"))
    files = None
    for form in ("jpeg", "png", "tiff"):
        part = _files(s, d, form)
        files = part if files is None else files.unionByName(part)
    done = writers.write_metadata(spread(files, "path").join(spread(c, "path"), "path"))
    found = extract.extract(done.where("error IS NULL"))
    p = lambda k: F.element_at("props", k)
    return found.select(F.col("path").cast("long").alias("k"), "mime", p("nie:title").alias("title"), p("nie:copyright").alias("copyright"), p("nfo:orientation").alias("orientation"), p("nmm:flash").alias("flash"), p("nfo:width").cast("long").alias("width"), "error")


def k21_write_audio(s, d):
    """Audio files with an old tag, written and read again; the audio after the tag stays as it was."""
    big = lambda c, size: F.lpad(F.hex(c), 2 * size, "0")
    old = F.concat(F.lit(b"ID3\4\0\0\0\0\x01\x00".hex() + b"TCOM\0\0\0\x05\0\0\3old!".hex()), F.lit("00" * (128 - 15)))
    audio = F.concat(F.lit("FFFB9000" + "00" * 32 + b"Xing".hex() + "00000001"), big(F.col("c_custkey") * 100, 4), F.lit("00" * 369), F.lit("FFFB9000" + "00" * 413))
    content = F.unhex(F.concat(F.when(F.col("c_custkey") % 2 == 0, old).otherwise(F.lit("")), audio))
    values = _props({"nie:title": F.col("c_name"), "nmm:performer": F.concat(F.lit("Ünï "), F.col("c_mktsegment")), "nmm:albumArtist": F.lit("various"), "nmm:trackNumber": F.col("c_nationkey").cast("string"), "nie:comment": F.lit("a comment"), "nmm:lyrics": F.lit("la la"), "nie:keyword": F.lit("k1,k2")})
    c = spread(store.table(s, d, "customer").withColumn("path", F.col("c_custkey").cast("string")), "path").select("path", F.lit("audio/mpeg").alias("mime"), content.alias("content"), values.alias("props"), F.sha2(F.unhex(audio), 256).alias("audio"))
    done = spread(writers.write_metadata(c), "path").join(c.select("path", "audio"), "path")
    size = F.conv(F.concat(*[F.lpad(F.bin(F.conv(F.hex(F.substring("content", k, 1)), 16, 10).cast("long")), 7, "0") for k in (7, 8, 9, 10)]), 2, 10).cast("int")
    same = F.sha2(F.expr("substring(content, size + 11)"), 256) == F.col("audio")
    done = done.withColumn("size", size).withColumn("same", same).select("path", "mime", "content", "same")
    found = extract.extract(done).join(done.select("path", "same"), "path")
    p = lambda k: F.element_at("props", k)
    return found.select(
        F.col("path").cast("long").alias("k"), p("nie:title").alias("title"), p("nmm:performer").alias("performer"), p("nmm:albumArtist").alias("album_artist"), p("nmm:trackNumber").alias("track"), p("nie:comment").alias("comment"),
        p("nmm:lyrics").alias("lyrics"), p("nie:keyword").alias("keywords"), p("nmm:composer").alias("composer"), p("nfo:duration").cast("long").alias("seconds"), "same", "error",
    )


QUERIES |= {"k21_write_images": k21_write_images, "k21_write_audio": k21_write_audio}
SQL |= {
    "k21_write_images": """SELECT c_custkey AS k, mime, 'neu & <' || c_name || '>' AS title, c_mktsegment AS copyright, 'nfo:orientation-bottom' AS orientation,
        CASE WHEN c_nationkey % 2 = 0 THEN 'nmm:flash-on' ELSE 'nmm:flash-off' END AS flash, CASE mime WHEN 'image/jpeg' THEN c_custkey % 60000 ELSE c_custkey END AS width, NULL AS error FROM customer, (VALUES ('image/jpeg'), ('image/png'), ('image/tiff')) v(mime)""",
    "k21_write_audio": """SELECT c_custkey AS k, c_name AS title, 'Ünï ' || c_mktsegment AS performer, 'various' AS album_artist, CAST(c_nationkey AS VARCHAR) AS track, 'a comment' AS comment, 'la la' AS lyrics, 'k1,k2' AS keywords,
        CASE WHEN c_custkey % 2 = 0 THEN 'old!' END AS composer, c_custkey * 100 * 1152 // 44100 AS seconds, true AS same, NULL AS error FROM customer""",
}
