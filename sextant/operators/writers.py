"""Metadata written back into files.

Images get an XMP packet in which only the properties that are written change:
one segment of a JPEG, chunk of a PNG, block of a GIF or value of a TIFF file
is replaced or added, and every other byte stays.  Audio files get an ID3 tag.
``write_metadata`` works on contents in a table; ``write_back`` on files, by a
copy beside the file that takes its place at once or not at all.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from sextant.functions.media import METERING, ORIENTATIONS
from sextant.functions.tables import map_batches
from sextant.operators import id3, overlays
from sextant.operators.packets import PREFIXES, RDF, XML

URIS = {prefix: uri for uri, prefix in reversed(PREFIXES.items())}
# Where a property is written; the first place that readers look at is among them.
PLACES = {
    "nie:title": "dc:title exif:Title", "nco:creator": "dc:creator", "nco:contributor": "dc:contributor", "nie:description": "dc:description", "nie:copyright": "exif:Copyright dc:rights", "nie:comment": "exif:UserComment",
    "nie:keyword": "dc:subject", "nie:contentCreated": "dc:date exif:Date", "nfo:orientation": "tiff:Orientation", "nmm:meteringMode": "exif:MeteringMode", "nmm:whiteBalance": "exif:WhiteBalance", "nmm:flash": "exif:Flash",
    "nmm:focalLength": "exif:FocalLength", "nmm:exposureTime": "exif:ExposureTime", "nmm:isoSpeed": "exif:ISOSpeedRatings", "nmm:fnumber": "exif:FNumber", "nfo:manufacturer": "exif:Make", "nfo:model": "exif:Model",
    "nfo:heading": "exif:GPSImgDirection", "nco:locality": "photoshop:City", "nco:region": "photoshop:State", "nco:streetAddress": "photoshop:Location", "nco:country": "photoshop:Country",
    "slo:latitude": "exif:GPSLatitude", "slo:longitude": "exif:GPSLongitude", "slo:altitude": "exif:GPSAltitude",
}
LISTS = {"dc:title": "Alt", "dc:description": "Alt", "dc:rights": "Alt", "dc:creator": "Seq", "dc:contributor": "Bag", "dc:subject": "Bag", "dc:date": "Seq"}
SEGMENT, LONGEST = b"http://ns.adobe.com/xap/1.0/\0", 65_533
KEYWORD = b"XML:com.adobe.xmp"
TURNED = (*ORIENTATIONS[:2], ORIENTATIONS[3], ORIENTATIONS[2], *ORIENTATIONS[4:])
IMAGES = ("image/jpeg", "image/png", "image/gif", "image/tiff")
AUDIO = ("audio/mpeg", "audio/x-mp3")


def _degrees(value: str, halves: str) -> str:
    x = float(value)
    return f"{int(abs(x))},{abs(x) % 1 * 60:.8f}{halves[x < 0]}"


def told(prop: str, value: str) -> str:
    """A value as packets write it."""
    end = value.rpartition("-")[2]
    if prop == "nfo:orientation":
        return str(TURNED.index(value.removeprefix("nfo:orientation-")) + 1)
    if prop == "nmm:meteringMode":
        mode = value.removeprefix("nmm:metering-mode-")
        return str(METERING.index(mode)) if mode in METERING and mode != "other" else "255"
    if prop in ("nmm:whiteBalance", "nmm:flash"):
        return "1" if end in ("manual", "on") else "0"
    if prop in ("slo:latitude", "slo:longitude"):
        return _degrees(value, "NS" if prop == "slo:latitude" else "EW")
    return value


def edited(packet: bytes | None, values: dict[str, str | None]) -> bytes:
    """The packet with ``values`` in place of what it said of these properties; an empty value takes a property away."""
    for prefix, uri in URIS.items():
        ElementTree.register_namespace(prefix, uri)
    ElementTree.register_namespace("rdf", RDF[1:-1])
    ElementTree.register_namespace("x", "adobe:ns:meta/")
    try:
        root = ElementTree.fromstring((packet or b"").strip(b"\0 \r\n\t"))
    except ElementTree.ParseError:
        root = ElementTree.Element("{adobe:ns:meta/}xmpmeta")
    rdf = root if root.tag == RDF + "RDF" else root.find(RDF + "RDF")
    if rdf is None:
        rdf = ElementTree.SubElement(root, RDF + "RDF")
    abouts = rdf.findall(RDF + "Description") or [ElementTree.SubElement(rdf, RDF + "Description", {RDF + "about": ""})]
    for prop, value in values.items():
        if prop not in PLACES:
            raise ValueError(f"no place in a packet for {prop}")
        for place in PLACES[prop].split():
            prefix, _, name = place.partition(":")
            tag = f"{{{URIS[prefix]}}}{name}"
            for about in abouts:
                about.attrib.pop(tag, None)
                for e in about.findall(tag):
                    about.remove(e)
            if value in (None, ""):
                continue
            node = ElementTree.SubElement(abouts[0], tag)
            if place not in LISTS:
                node.text = told(prop, value)
                continue
            items = ElementTree.SubElement(node, RDF + LISTS[place])
            for text in [w.strip() for w in value.split(",") if w.strip()] if place == "dc:subject" else [value]:
                item = ElementTree.SubElement(items, RDF + "li", {XML + "lang": "x-default"} if LISTS[place] == "Alt" else {})
                item.text = text
    body = ElementTree.tostring(root, encoding="utf-8").partition(b"?>\n")
    return b'<?xpacket begin="\xef\xbb\xbf" id="W5M0MpCehiHzreSzNTczkc9d"?>' + (body[2] or body[0]) + b'<?xpacket end="w"?>'


def _jpeg(data: bytes, values: dict) -> bytes:
    at, place, old = 2, 2, None
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : end].startswith(SEGMENT):
            old = old or (at, end)
        elif data[at + 1] in (0xE0, 0xE1):
            place = end  # after the format's and the camera's own segments
        at = end
    packet = edited(data[old[0] + 4 + len(SEGMENT) : old[1]] if old else None, values)
    if len(SEGMENT) + len(packet) > LONGEST:
        raise ValueError("the packet is too long for a segment")
    start, end = old or (place, place)
    return data[:start] + b"\xff\xe1" + struct.pack(">H", 2 + len(SEGMENT) + len(packet)) + SEGMENT + packet + data[end:]


def _png(data: bytes, values: dict) -> bytes:
    at, place, old, packet = 8, None, None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body, end = data[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"iTXt" and body.startswith(KEYWORD + b"\0") and old is None:
            rest = body[len(KEYWORD) + 3 :].partition(b"\0")[2].partition(b"\0")[2]
            old, packet = (at, end), zlib.decompress(rest) if body[len(KEYWORD) + 1] == 1 else rest
        if kind in (b"IDAT", b"IEND") and place is None:
            place = at
        at = end
    if place is None:
        raise ValueError("a PNG file without an end")
    body = KEYWORD + b"\0\0\0\0\0" + edited(packet, values)
    start, end = old or (place, place)
    return data[:start] + struct.pack(">I", len(body)) + b"iTXt" + body + struct.pack(">I", zlib.crc32(b"iTXt" + body)) + data[end:]


def _gif(data: bytes, values: dict) -> bytes:
    mark, trailer = b"\x21\xff\x0bXMP DataXMP", bytes([1, *range(255, -1, -1), 0])
    start = data.find(mark)
    stop = data.find(trailer, start) if start >= 0 else -1
    packet = edited(data[start + len(mark) : stop] if stop >= 0 else None, values)
    if stop < 0:
        start, stop = data.rfind(b";"), data.rfind(b";") - len(trailer)
        if start < 0:
            raise ValueError("a GIF file without an end")
    return b"GIF89a" + data[6:start] + mark + packet + trailer + data[stop + len(trailer) :]


def _tiff(data: bytes, values: dict) -> bytes:
    """The packet goes to the end; a directory that has no place for it is copied there too."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    main = overlays.directory(data, at)
    packet = edited(main[overlays.XMP_TAG][1] if overlays.XMP_TAG in main else None, values)
    out = bytearray(data + b"\0" * (len(data) % 2))
    n = struct.unpack_from(order + "H", data, at)[0]
    rows = [bytes(data[at + 2 + 12 * k : at + 14 + 12 * k]) for k in range(n)]
    entry = struct.pack(order + "HHII", overlays.XMP_TAG, 7, len(packet), len(out))
    out += packet + b"\0" * (len(packet) % 2)
    for k, row in enumerate(rows):
        if struct.unpack_from(order + "H", row)[0] == overlays.XMP_TAG:
            out[at + 2 + 12 * k : at + 14 + 12 * k] = entry
            return bytes(out)
    rows = sorted([*rows, entry], key=lambda r: struct.unpack_from(order + "H", r)[0])
    out[4:8] = struct.pack(order + "I", len(out))
    out += struct.pack(order + "H", len(rows)) + b"".join(rows) + data[at + 2 + 12 * n : at + 6 + 12 * n]
    return bytes(out)


# How files of each type begin.
BEGINNINGS = {"image/jpeg": (b"\xff\xd8\xff",), "image/png": (b"\x89PNG\r\n\x1a\n",), "image/gif": (b"GIF87a", b"GIF89a"), "image/tiff": (b"II*\0", b"MM\0*")}


def rewritten(mime: str | None, data: bytes, values: dict[str, str | None]) -> bytes:
    """The bytes of a file of that type with ``values`` in it; an error if no writer takes the type, or the bytes aren't of it."""
    if mime in BEGINNINGS:
        if not data.startswith(BEGINNINGS[mime]):
            raise ValueError(f"the file is not of the type {mime}")
        return {"image/jpeg": _jpeg, "image/png": _png, "image/gif": _gif, "image/tiff": _tiff}[mime](data, values)
    if mime in AUDIO:
        id3.check(data)
        return id3.written(data, values)
    raise ValueError(f"no writer for {mime}")


def write_metadata(files: DataFrame) -> DataFrame:
    """``path, mime, content, error`` of files (path, mime, content, props); where there is an error the content is the old one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, mime, content, props in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    out.append((path, mime, rewritten(mime, content or b"", dict(props or [])), None))
                except (ValueError, struct.error, zlib.error, IndexError) as e:
                    out.append((path, mime, content, f"{type(e).__name__}: {e}"[:200]))
            kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["path", "mime", "content", "error"])

    return map_batches(files.select("path", "mime", "content", "props"), run, "path string, mime string, content binary, error string")


def replace_file(path: str, mime: str, values: dict[str, str | None]) -> None:
    """Writes into a copy with the file's mode and times of access, checks it, and moves it over the file; on any error the copy goes and the file stays."""
    copy = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    if os.path.islink(path) or not os.access(path, os.W_OK):
        raise PermissionError(f"{path} can't be written")
    try:
        with open(path, "rb") as f:
            old = f.read()
        new = rewritten(mime, old, values)
        shutil.copy2(path, copy)
        with open(copy, "wb") as f:
            f.write(new)
            f.flush()
            os.fsync(f.fileno())
        os.replace(copy, path)
    finally:
        if os.path.exists(copy):
            os.unlink(copy)


def write_back(requests: DataFrame) -> DataFrame:
    """``path, written, error`` after writing requests (path, mime, props) into files that all executors see.

    Each request is of its own: what fails leaves its file as it was.  A task
    that runs again writes the same once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, mime, props in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    replace_file(path.removeprefix("file://"), mime, dict(props or []))
                    out.append((path, True, None))
                except (ValueError, OSError, struct.error, zlib.error, IndexError) as e:
                    out.append((path, False, f"{type(e).__name__}: {e}"[:200]))
            kinds = (pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names=["path", "written", "error"])

    return map_batches(requests.select("path", "mime", "props"), run, "path string, written boolean, error string")
