"""Queries of packages, disc images and the shipped rules, over the driver's tables."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from sextant.functions.paths import glob_regex
from sextant.functions.tables import map_batches, spread
from sextant.operators import discs, extract, policy, roots
from sextant.plans import store
from sextant.rules import RULES

KINDS = ("text", "presentation", "spreadsheet", "graphics")
NAMES = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:meta="urn:oasis:names:tc:opendocument:xmlns:meta:1.0"'


def open_document(kind: str, title: str, words: list[str]) -> bytes:
    """A package that says the same words in paragraphs, spans, cells and shapes."""
    a, b, c = words
    inner = f"<office:annotation>{a}!</office:annotation><text:p>{a}<text:span>{b}</text:span></text:p><table:table-cell>{c}</table:table-cell><draw:frame>{a}</draw:frame><text:h>{b}</text:h>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", f"application/vnd.oasis.opendocument.{kind}")
        z.writestr("meta.xml", f"<office:document-meta {NAMES}><dc:title>{title}</dc:title><meta:document-statistic meta:page-count='{len(title)}'/></office:document-meta>")
        z.writestr("content.xml", f"<office:document-content {NAMES}>{inner}</office:document-content>", zipfile.ZIP_DEFLATED)
    return out.getvalue()


def e_open_document(s, d):
    n = spread(store.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(str(k), f"application/vnd.oasis.opendocument.{KINDS[k % 4]}", open_document(KINDS[k % 4], name, [segment, f"n{nation}", f"k{k}"])) for k, name, segment, nation in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            kinds = (pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, kinds, strict=True)], names=["path", "mime", "content"])

    found = extract.extract(map_batches(n, run, "path string, mime string, content binary"))
    return found.select(F.col("path").cast("long").alias("k"), F.element_at("props", "nie:title").alias("title"), F.element_at("props", "nfo:pageCount").cast("long").alias("pages"), "text", "error")


def disc(start: str | None, program: str, default: bool) -> bytes:
    """A small raw image: descriptor, root directory of two blocks, start file and program."""
    block = lambda data: b"\0" * discs.HEAD + data.ljust(discs.CONTENT, b"\0") + b"\0" * (discs.FRAME - discs.HEAD - discs.CONTENT)
    record = lambda name, at, flags=0: (lambda size: bytes([size, 0]) + struct.pack("<i", at) + b"\0" * 19 + bytes([flags]) + b"\0" * 6 + bytes([len(name)]) + name.ljust(size - 33, b"\0"))(33 + len(name) + (1 - len(name) % 2))
    root = record(b"\0", 17, 2) + record(b"\1", 17, 2) + record(b"DATA", 18, 2) + record(program.encode() + b";1", 20)
    root += record(discs.START, 19) if start is not None else b""
    root += record(discs.DEFAULT, 20) if default else b""
    descriptor = b"\1CD001".ljust(discs.ROOT, b"\0") + record(b"\0", 17, 2)
    return block(b"") * 16 + block(descriptor) + block(root) + block(b"") + block((start or "").encode()) + block(b"program")


#: Images that are built at once, 3 MB.
IMAGES = 64


def disc_games(s, d):
    """Sheets and images of the driver's parts: some name a program that is there, some don't, some have no start file."""
    p = store.table(s, d, "part").where("p_partkey % 4 = 0").select("p_partkey", "p_size")
    path = F.concat(F.lit("/games/"), F.col("p_partkey").cast("string"))
    mode = F.when(F.col("p_size") % 5 == 0, "AUDIO").otherwise("MODE2/2352")
    text = F.concat(F.lit('FILE "/elsewhere/'), F.col("p_partkey").cast("string"), F.lit('.bin" BINARY\n  TRACK 01 '), mode, F.lit("\n    INDEX 01 00:00:00\n"))
    sheets = p.select(F.concat(path, F.lit(".cue")).alias("path"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, IMAGES):
                rows = []
                for k, size in zip(*[c.to_pylist() for c in batch.slice(at, IMAGES).columns], strict=True):
                    program = f"SLUS_{k % 1000:03d}"
                    start = (f"BOOT = cdrom:\\{program};1\r\nTCB = 4", f"TCB = 4\nBOOT=cdrom:\\{program.lower()}", "BOOT = cdrom:\\ABSENT;1\r\n", None, None)[size % 7 % 5]
                    rows.append((f"/games/{k}.bin", disc(start, program, size % 7 == 4)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    return discs.games(sheets, map_batches(spread(p, "p_partkey"), run, "path string, content binary"))


def _rule_table(s):
    rows = [(name, module or None, "|".join(f"(?:{glob_regex(m)})" for m in mimes.split()), None, types.split()) for name, module, graph, types, mimes in RULES]
    return s.createDataFrame(rows, "rule_order string, module string, allow_regex string, block_regex string, types array<string>")


#: Types that files of the driver's parts are of, by their size.
MIMES = ("image/png", "application/vnd.oasis.opendocument.text", "audio/mpeg", "audio/flac", "video/mp4", "video/webm", "text/plain", "text/markdown", "application/x-cue", "application/pdf", "x/unknown", "application/vnd.ms-word.document", "inode/directory", "image/svg+xml", "application/x-gba-rom")


def _typed(s, d):
    mime = F.element_at(F.array(*[F.lit(m) for m in MIMES]), (F.col("p_partkey") % len(MIMES) + 1).cast("int"))
    return store.table(s, d, "part").select("p_partkey", mime.alias("mime"))


def p20_shipped_rules(s, d):
    files = _typed(s, d)
    found = files.join(roots.dispatch(files, _rule_table(s)), "mime", "left")
    return found.groupBy("mime", "module").agg(F.count("*").alias("n"))


def a13_shipped_types(s, d):
    files = _typed(s, d)
    types = policy.fallback_types(files.select("mime"), _rule_table(s))
    return files.join(types, "mime").select("p_partkey", "mime", F.array_join("types", ",").alias("types"))


QUERIES = {f.__name__: f for f in (e_open_document, disc_games, p20_shipped_rules, a13_shipped_types)}
# What the rules give for MIMES, read off them by hand.
_MODULES = {"image/png": "png", "application/vnd.oasis.opendocument.text": "oasis", "audio/mpeg": "mp3", "audio/flac": "gstreamer", "video/mp4": "gstreamer", "video/webm": "gstreamer", "text/plain": "text", "text/markdown": "text", "application/x-cue": "disc-generic", "application/pdf": "pdf", "application/vnd.ms-word.document": "msoffice"}
_TYPES = {"image/png": "nfo:Image,nmm:Photo", "application/vnd.oasis.opendocument.text": "nfo:PaginatedTextDocument", "audio/mpeg": "nmm:MusicPiece,nfo:Audio", "audio/flac": "nfo:Audio", "video/mp4": "nfo:Media,nfo:Video", "video/webm": "nmm:Video", "text/plain": "nfo:Document,nfo:PlainTextDocument", "text/markdown": "nfo:Document,nfo:PlainTextDocument", "application/x-cue": "nfo:Software", "application/pdf": "nfo:PaginatedTextDocument", "application/vnd.ms-word.document": "nfo:Document", "inode/directory": "nfo:Folder", "image/svg+xml": "nfo:Image,nfo:VectorImage", "application/x-gba-rom": "nfo:GameImage"}


def _case(values: dict) -> str:
    return "CASE mime " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_TYPED = "(SELECT p_partkey, ([" + ", ".join(f"'{m}'" for m in MIMES) + f"])[p_partkey % {len(MIMES)} + 1] AS mime FROM part)"
SQL = {
    "e_open_document": """SELECT c_custkey AS k, c_name AS title, length(c_name) AS pages, NULL AS error, CASE c_custkey % 4
            WHEN 0 THEN a || b || c || ' ' || b WHEN 1 THEN a || '! ' || a || ' ' || b || ' ' || c || ' ' || a || ' ' || b || ' ' ELSE a || ' ' || b || ' ' || b || ' ' END AS text
        FROM (SELECT *, c_mktsegment AS a, 'n' || c_nationkey AS b, 'k' || c_custkey AS c FROM customer)""",
    "disc_games": """SELECT '/games/' || p_partkey || '.cue' AS path, '/games/' || p_partkey || '.bin' AS image, 'psx' AS system FROM part WHERE p_partkey % 4 = 0 AND p_size % 5 <> 0 AND p_size % 7 IN (0, 1, 4, 5, 6)""",
    "p20_shipped_rules": f"SELECT mime, {_case(_MODULES)} AS module, count(*) AS n FROM {_TYPED} GROUP BY ALL",
    "a13_shipped_types": f"SELECT p_partkey, mime, {_case(_TYPES)} AS types FROM {_TYPED} WHERE mime <> 'x/unknown'",
}


def e_ps(s, d):
    """Page descriptions, every third packed, with dates of four forms and escaped bytes."""
    o = spread(store.table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    forms = ("'('HH:mm EEEE d MMMM yyyy')'", "EEE MMM d HH:mm:ss yyyy", "d MMM yyyy HH:mm:ss '-0600'", "'about' yyyy")
    n = F.col("o_orderkey")
    date = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (n % 4 + 1).cast("int"))
    text = F.concat(F.lit("%!PS-Adobe-1.0\n%%Title: (order \\303\\230 "), n.cast("string"), F.lit(")\n%%Creator: "), F.col("o_orderpriority"), F.lit("\n%%CreationDate: "), date, F.lit("\n%%Pages: (atend)\n%%EndComments\n%%Title: no\nshowpage\n%%Trailer\n%%Pages: "), (n % 9).cast("string"), F.lit("\n"))
    rows = o.select(n.alias("k"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(str(k), "application/x-gzpostscript" if k % 3 == 0 else "application/postscript", gzip.compress(t.encode(), 1, mtime=0) if k % 3 == 0 else t.encode()) for k, t in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            kinds = (pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names=["path", "mime", "content"])

    found = extract.extract(map_batches(rows, run, "path string, mime string, content binary"))
    p = lambda k: F.element_at("props", k)
    return found.select(F.col("path").cast("long").alias("k"), p("nie:title").alias("title"), p("nco:creator").alias("creator"), p("nie:contentCreated").alias("created"), p("nfo:pageCount").alias("pages"), "error")


def e_desktop(s, d):
    """Desktop entries of applications and links, and broken ones."""
    p = spread(store.table(s, d, "part"), "p_partkey")
    kind = F.col("p_partkey") % 3
    app = F.concat(F.lit("[Desktop Entry]\nType=Application\nName= "), "p_name", F.lit(" \nName[de]=x\nExec=run %f\nCategories="), "p_type", F.lit(";B;\n"))
    link = F.concat(F.lit("# a link\n[Desktop Entry]\nName="), "p_name", F.lit("\nType=Link\nURL=http://p/"), F.col("p_partkey").cast("string"), F.lit("\n"))
    text = F.when(kind == 0, app).when(kind == 1, link).otherwise("no entry")
    found = extract.extract(p.select(F.col("p_partkey").cast("string").alias("path"), F.lit("application/x-desktop").alias("mime"), F.encode(text, "UTF-8").alias("content")))
    v = lambda k: F.element_at("props", k)
    return found.select(F.col("path").cast("long").alias("k"), F.try_element_at("rdf_types", F.lit(1)).alias("class"), v("nie:title").alias("title"), v("nie:url").alias("url"), v("nfo:softwareCmdLine").alias("command"), v("nie:isLogicalPartOf").alias("categories"), F.col("error").isNotNull().alias("broken"))


def e_icon(s, d):
    """Icons of some images each; 0 stands for 256."""
    byte = lambda c: F.lpad(F.hex(c % 256), 2, "0")
    c = F.col("p_size")
    entry = lambda k: F.concat(byte(c + k), byte(c * k), F.lit("00" * 14))
    content = F.unhex(F.concat(F.lit("000001000300"), entry(1), entry(2), entry(3)))
    found = extract.extract(spread(store.table(s, d, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("path"), F.lit("image/vnd.microsoft.icon").alias("mime"), content.alias("content")))
    return found.select(F.col("path").cast("long").alias("k"), F.element_at("props", "nfo:width").cast("long").alias("width"), F.element_at("props", "nfo:height").cast("long").alias("height"), "error")


def e_abiword(s, d):
    """Word processor files with keywords and sections, and broken ones."""
    p = spread(store.table(s, d, "part"), "p_partkey")
    text = F.concat(F.lit('<abiword><metadata><m key="dc.title">'), "p_name", F.lit('</m><m key="abiword.keywords">'), "p_type", F.lit('</m></metadata><section><p>'), "p_brand", F.lit("<c>!</c></p><p>"), F.col("p_size").cast("string"), F.lit("</p></section>"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("</abiword>"))
    found = extract.extract(p.select(F.col("p_partkey").cast("string").alias("path"), F.lit("application/x-abiword").alias("mime"), F.encode(text, "UTF-8").alias("content")))
    return found.select(F.col("path").cast("long").alias("k"), F.element_at("props", "nie:title").alias("title"), F.element_at("props", "nie:keyword").alias("keywords"), "text", F.col("error").isNotNull().alias("broken"))


QUERIES |= {f.__name__: f for f in (e_ps, e_desktop, e_icon, e_abiword)}
SQL |= {
    "e_ps": """SELECT o_orderkey AS k, 'order Ø ' || o_orderkey AS title, o_orderpriority AS creator, CAST(o_orderkey % 9 AS VARCHAR) AS pages, NULL AS error,
        CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:00+0000') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+0000') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S-0600') END AS created FROM orders""",
    "e_desktop": """SELECT k, CASE m WHEN 0 THEN 'nfo:SoftwareApplication' WHEN 1 THEN 'nfo:Bookmark' END AS class, CASE WHEN m < 2 THEN p_name END AS title, CASE WHEN m = 1 THEN 'http://p/' || k END AS url,
        CASE WHEN m = 0 THEN 'run %f' END AS command, CASE WHEN m = 0 THEN p_type || ';B' END AS categories, m = 2 AS broken FROM (SELECT *, p_partkey AS k, p_partkey % 3 AS m FROM part)""",
    "e_icon": """SELECT p_partkey AS k, list_max([CASE WHEN (p_size + i) % 256 = 0 THEN 256 ELSE (p_size + i) % 256 END FOR i IN [1, 2, 3]])::BIGINT AS width, list_max([CASE WHEN p_size * i % 256 = 0 THEN 256 ELSE p_size * i % 256 END FOR i IN [1, 2, 3]])::BIGINT AS height, NULL AS error FROM part""",
    "e_abiword": """SELECT p_partkey AS k, CASE WHEN ok THEN p_name END AS title, CASE WHEN ok THEN replace(p_type, ' ', ',') END AS keywords, CASE WHEN ok THEN p_brand || ' ! ' || p_size END AS text, NOT ok AS broken FROM (SELECT *, p_partkey % 5 <> 0 AS ok FROM part)""",
}
