"""Secret scan with a recursive decoding worklist.

The scan of a text starts with the text itself as the first layer.  Every
layer is searched for secrets; then its percent-encoded, Unicode-escaped and
base64 stretches (also over several lines), and the data compressed inside
them, however often, are unwrapped into new layers, which join the worklist
until none is left.  A layer whose text was seen before in the same document
at the same place is not unwrapped again, so chains that decode to themselves
end.  Every layer keeps, for each of its characters, the stretch of the
original text it came from; a secret found in any layer is reported by that
stretch.

Base64 stretches have 16 characters at least and are read at all four
alignments, as letters before them may belong to a path or a name.  Compressed
data is found by its signature wherever it begins; raw deflate data, which has
none, at the beginning of a stretch and after each sign between its words.
Bytes are read as UTF-8 and, where there are zero bytes, as UTF-16.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .staging import load

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT, RUN = re.compile(r"%[0-9A-Fa-f]{2}"), re.compile(r"[^\s\"'<>]+")
ESCAPED = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 broken into lines, indented or quoted.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t>]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Signs of base64 that may also end a name before it.
SIGNS = re.compile(r"[+/_-]")
#: How compressed data begins: gzip, bzip2, xz, zstd, zlib.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]", re.S)
#: What a layer must have to hold another.
WRAPPED = re.compile(f"{PERCENT.pattern}|{ESCAPED.pattern}|{ENCODED.pattern}")
LONE = re.compile("[\ud800-\udfff]")
#: A compressed layer that grows beyond this many bytes is refused as a bomb (its wrapped form is still scanned).
LAYER_BYTES = 64 << 20
#: Compressed bytes read at a time.
FEED = 4096

SPANS = "array<struct<kind:string,start:long,end:long,depth:int,via:string,value:string>>"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets of one layer."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _opener(head: bytes):
    """A decompressor for data that begins so, if it looks compressed."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and int.from_bytes(head[:2]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflate(data: memoryview, at: int) -> tuple[bytes | None, int]:
    """(content, end) of the compressed data that begins there, all its members; None if there is none, or too much."""
    out = bytearray()
    try:
        if data[at : at + 4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(data[at:], read_across_frames=True) as reader:
                at += 4
                while len(out) <= LAYER_BYTES and (piece := reader.read(1 << 16)):
                    out += piece
                at = len(data)
        while len(out) <= LAYER_BYTES and (z := _opener(bytes(data[at : at + 6]))):
            next_ = at
            while not z.eof and next_ < len(data) and len(out) <= LAYER_BYTES:
                out += z.decompress(data[next_ : next_ + FEED])
                next_ = min(next_ + FEED, len(data))
            at = next_ - len(z.unused_data)
            while at < len(data) and data[at] == 0:
                at += 1
    except (zlib.error, zstandard.ZstdError, lzma.LZMAError, OSError, EOFError, ValueError, MemoryError):
        pass  # what was read before stays
    return (bytes(out) if 0 < len(out) <= LAYER_BYTES else None), at


def _packed_in(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(begin, content) of all compressed data in ``data``; what was read as part of one isn't read again."""
    view, done = memoryview(data), 0
    for at in (0, *(m.start() for m in PACKED.finditer(data) if m.start())):
        if at >= done:
            content, end = _inflate(view, at)
            if content is not None:
                done = end
                yield at, content


def _inflate_raw(data: memoryview) -> bytes | None:
    """The content of raw deflate data; None if its first bytes already aren't that."""
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(data[:256], LAYER_BYTES + 1)
        if not z.eof and len(data) > 256:
            out += z.decompress(z.unconsumed_tail + data[256:], max(LAYER_BYTES + 1 - len(out), 1))
    except zlib.error:
        return None
    return out if out and len(out) <= LAYER_BYTES else None


def _contents(data: bytes, begins: Iterable[int] = (0,)) -> Iterator[tuple[str, int, bytes]]:
    """(way, begin, content) of compressed data, and of what is compressed in it.  ``begins``: where raw deflate data may start."""
    view, seen = memoryview(data), {hashlib.sha256(data).digest()}
    work = [("compressed", at, content) for at, content in _packed_in(data)]
    work += [("deflated", at, content) for at in begins if at < len(data) and (content := _inflate_raw(view[at:])) is not None]
    while work:
        way, at, content = work.pop()
        if (digest := hashlib.sha256(content).digest()) not in seen:
            seen.add(digest)
            yield way, at, content
            work += [(f"{way}>compressed", at, inner) for _, inner in _packed_in(content)]


def _wide(data: bytes) -> Iterator[tuple[str, int, str]]:
    """(way, first byte, text) of bytes read as UTF-16 of both orders, from the first and the second byte."""
    for way, kind in (("utf-16-le", "<u2"), ("utf-16-be", ">u2")):
        for first in (0, 1):
            codes = np.frombuffer(data, kind, (len(data) - first) // 2, first).astype("<u4")
            codes[(codes >= 0xD800) & (codes < 0xE000)] = 0xFFFD
            yield way, first, codes.tobytes().decode("utf-32-le")


def _from_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """(way, layer) of bytes, each of which has its own stretch of the original; one that isn't UTF-8 is one U+FFFD.

    None where a layer has neither a secret nor anything to unwrap.
    """
    if b"\0" in data:
        for way, first, text in _wide(data):
            if base_spans(text) or WRAPPED.search(text):
                stop = first + 2 * len(text)
                yield way, text, starts[first:stop:2], ends[first + 1 : stop : 2]
    text = data.decode("utf-8", "surrogateescape")
    if not (base_spans(text) or WRAPPED.search(text)):
        return
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    escaped = (codes >= 0xDC80) & (codes < 0xDD00)
    width = np.where(escaped, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
    stop = np.cumsum(width)
    yield "", LONE.sub("\ufffd", text), starts[stop - width], ends[stop - 1]


def unwrap(text: str, starts: np.ndarray | None, ends: np.ndarray | None) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """(way, text, starts, ends) of every layer directly inside this one.  None: the original text."""

    def at(i: int) -> int:
        return i if starts is None else int(starts[i])

    def to(i: int) -> int:
        return i + 1 if ends is None else int(ends[i])

    if PERCENT.search(text):
        for m in RUN.finditer(text):
            if not PERCENT.search(text, *m.span()):
                continue
            data, lo, hi, i = bytearray(), [], [], m.start()
            while i < m.end():
                width = 3 if text[i] == "%" and re.match(r"[0-9A-Fa-f]{2}", text[i + 1 : i + 3]) else 1
                piece = unquote_to_bytes(text[i : i + 3]) if width == 3 else text[i].encode("utf-8", "replace")
                data += piece
                lo += [at(i)] * len(piece)
                hi += [to(i + width - 1)] * len(piece)
                i += width
            escape = PERCENT.search(text, *m.span()).start() - m.start()
            before = len(text[m.start() : m.start() + escape].encode("utf-8", "replace"))
            yield from _layers("url", bytes(data), np.array(lo), np.array(hi), {before})
    if "\\" in text and ESCAPED.search(text):
        # Escapes are resolved in the whole layer: a secret may be escaped only in part.
        parts, lo, hi, last = [], [], [], 0
        for m in [*ESCAPED.finditer(text), None]:
            stop = m.start() if m else len(text)
            parts.append(text[last:stop])
            lo += [at(i) for i in range(last, stop)]
            hi += [to(i) for i in range(last, stop)]
            if m:
                code = int(m[0].strip("\\ux{}"), 16) if m[0][2] != "{" else int(m[0][3:-1], 16)
                parts.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
                lo.append(at(m.start()))
                hi.append(to(m.end() - 1))
                last = m.end()
        yield "unicode", "".join(parts), np.array(lo), np.array(hi)
    for body, places, begins in _encoded(text):
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        k = np.arange(len(data))
        first = k // 3 * 4 + k % 3
        first, last = places[first], places[np.minimum(first + 1, len(places) - 1)]
        yield from _layers("base64", data, first if starts is None else starts[first], last + 1 if ends is None else ends[last], begins)


def _layers(way: str, data: bytes, starts: np.ndarray, ends: np.ndarray, begins: Iterable[int]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """(way, layer) of decoded bytes and of the data compressed in them."""
    for inner, at, content in _contents(data, begins):
        for kind, *layer in _from_bytes(content, *_whole(content, starts[at], ends[-1])):
            yield ">".join(filter(None, (way, inner, kind))), *layer
    for kind, *layer in _from_bytes(data, starts, ends):
        yield ">".join(filter(None, (way, kind))), *layer


def _whole(content: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same stretch for all bytes."""
    return np.broadcast_to(np.int64(start), len(content)), np.broadcast_to(np.int64(end), len(content))


def _encoded(text: str) -> Iterator[tuple[str, np.ndarray, set[int]]]:
    """(characters, places, where deflated data may begin) of all base64 stretches: of each line, and of adjoining lines together.

    A stretch is read from each of its first four characters.  Joined lines are
    also read from each line that begins like compressed data.
    """
    plain = str.maketrans("-_", "+/")

    def read(body: str, places: np.ndarray, begin: int, marks: list[int]) -> tuple[str, np.ndarray, set[int]]:
        stop = len(body) - ((len(body) - begin) % 4 == 1)
        return body[begin:stop].translate(plain), places[begin:stop], {(m - begin) // 4 * 3 for m in marks if m >= begin and (m - begin) % 4 == 0}

    for m in ENCODED.finditer(text):
        body, places = m[0].rstrip("="), np.arange(m.start(), m.end())
        marks = [0, *(x.end() for x in SIGNS.finditer(body))]
        for begin in range(4):
            yield read(body, places, begin, marks)
    for m in LINES.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, *m.span())]
        places = np.concatenate([np.arange(*x) for x in lines])
        joined = "".join(text[a:b] for a, b in lines)
        firsts = np.cumsum([0, *[b - a for a, b in lines]])[:-1].tolist()
        heads = {k for k in firsts if _packed(base64.b64decode(joined[k : k + 12].translate(plain).ljust(12, "A")))}
        for begin in sorted({0, 1, 2, 3, *heads}):
            yield read(joined, places, begin, firsts)


def _packed(head: bytes) -> bool:
    return bool(PACKED.match(head))


def find_secrets(text: str) -> list[tuple[str, int, int, int, str, str]]:
    """(kind, start, end, depth, via, value) by start, then kind; depth 0 is the text itself."""
    found = [(start, KINDS.index(kind), end, 0, "", text[start:end]) for start, kind, end in base_spans(text)]
    taken = {(s, k, e) for s, k, e, *_ in found}
    work, seen = [(0, "", text, None, None)], {(0, text)}
    while work:
        depth, via, layer, starts, ends = work.pop()
        if depth:
            for start, kind, end in base_spans(layer):
                span = (int(starts[start]), KINDS.index(kind), int(ends[start:end].max()))
                if span not in taken:
                    taken.add(span)
                    found.append((*span, depth, via, layer[start:end]))
        for way, inner, lo, hi in unwrap(layer, starts, ends):
            if inner != layer and (key := (int(lo[0]), inner)) not in seen:
                seen.add(key)
                work.append((depth + 1, f"{via}>{way}".lstrip(">"), inner, lo, hi))
    return [(KINDS[k], s, e, depth, via, value) for s, k, e, depth, via, value in sorted(found, key=lambda x: x[:4])]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: all secrets of every text, offsets in code points, end exclusive.

    A null text counts as empty; an empty text gives an empty array; repeated
    rows give repeated results; other columns are ignored.  ``depth`` counts the
    layers unwrapped (0: as written), ``via`` names them, ``value`` is the
    secret as decoded.  A stretch found twice with the same kind is reported
    once, as found at the lowest depth.
    """

    def each(doc_id, text):
        yield doc_id, [dict(zip(("kind", "start", "end", "depth", "via", "value"), x, strict=True)) for x in find_secrets(text or "")]

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), each, f"doc_id {id_type}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE: dict[str, str] = {}
