"""Metadata inside images and audio: EXIF directories, IPTC datasets, XMP packets and MPEG audio frames.

Each function reads bytes and gives properties; what several of them have is
settled by RANKS.
"""

from __future__ import annotations

import re
import struct
from functools import cache

from sextant.functions.media import DARK, METERING, ORIENTATIONS
from sextant.operators import packets

# Bytes of one value by TIFF type; tags of strings, of numbers and of directories.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TEXT_TAGS = {0x010D: "document_name", 0x010E: "description", 0x010F: "make", 0x0110: "model", 0x013B: "artist", 0x8298: "copyright", 0x0132: "time", 0x9003: "time_original"}
NUMBER_TAGS = {0x829A: "exposure_time", 0x829D: "fnumber", 0x8827: "iso_speed", 0x920A: "focal_length"}
EXIF_DIRECTORY, GPS_DIRECTORY, IPTC_TAG, XMP_TAG = 0x8769, 0x8825, 0x83BB, 0x02BC
# IPTC datasets of record 2.
IPTC_NAMES = {25: "keywords", 55: "date_created", 80: "byline", 85: "byline_title", 90: "city", 92: "sublocation", 95: "state", 101: "country", 110: "credit", 116: "copyright", 118: "contact", 131: "orientation"}


def first(*values: str | None) -> str | None:
    """The first that isn't blank, trimmed."""
    return next((v.strip() for v in values if v and v.strip()), None)


def iso_date(value: str | None) -> str | None:
    """``2007:04:15 10:11:12``, ``2007 04 15`` and ``20070415`` in ISO form; others as they are."""
    if m := re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)", value or ""):
        return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}"
    if m := re.fullmatch(r"(\d{4}) ?(\d\d) ?(\d\d)", value or ""):
        return f"{m[1]}-{m[2]}-{m[3]}T00:00:00"
    return value


def directory(tiff: bytes, at: int) -> dict[int, tuple[int, bytes]]:
    """(type, bytes) by tag of the directory that begins at an offset; the first of equal tags counts."""
    order, out = "<" if tiff[:2] == b"II" else ">", {}
    if at + 2 > len(tiff):
        return out
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        place = at + 2 + 12 * i
        if place + 12 > len(tiff):
            break
        tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, place)
        size = SIZES.get(kind, 0) * count
        start = place + 8 if size <= 4 else value
        out.setdefault(tag, (kind, tiff[start : start + size]))
    return out


def numbers(tiff: bytes, entry: tuple[int, bytes] | None) -> list[float]:
    """The values of an entry; a fraction over 0 is left out."""
    if entry is None or entry[0] not in (1, 3, 4, 5, 9, 10):
        return []
    kind, data = entry
    code = {1: "B", 3: "H", 4: "I", 5: "I", 9: "i", 10: "i"}[kind]
    width = struct.calcsize(code)
    flat = struct.unpack(("<" if tiff[:2] == b"II" else ">") + code * (len(data) // width), data[: len(data) // width * width])
    return [a / b for a, b in zip(flat[::2], flat[1::2], strict=False) if b] if kind in (5, 10) else list(flat)


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def _plain(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def exif(tiff: bytes) -> dict[str, str]:
    """Fields of the first, the EXIF and the GPS directory."""
    order = "<" if tiff[:2] == b"II" else ">"
    main = directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0])
    sub = {t: directory(tiff, int(n[0])) if (n := numbers(tiff, main.get(t))) else {} for t in (EXIF_DIRECTORY, GPS_DIRECTORY)}
    entries, gps = sub[EXIF_DIRECTORY] | main, sub[GPS_DIRECTORY]
    out: dict[str, str] = {}
    for tag, name in TEXT_TAGS.items():
        if tag in entries and entries[tag][0] == 2 and (text := entries[tag][1].split(b"\0")[0].decode("utf-8", "replace").strip()):
            out[name] = iso_date(text) if name.startswith("time") else text
    for tag, name in NUMBER_TAGS.items():
        if found := numbers(tiff, entries.get(tag)):
            out[name] = _plain(found[0])
    if found := numbers(tiff, entries.get(0x0112)):
        out["orientation"] = "nfo:orientation-" + (ORIENTATIONS[int(found[0]) - 1] if 1 <= found[0] <= 8 else "top")
    if found := numbers(tiff, entries.get(0x9207)):
        out["metering_mode"] = "nmm:metering-mode-" + (METERING[int(found[0])] if found[0] < len(METERING) else "other")
    if found := numbers(tiff, entries.get(0x9209)):
        out["flash"] = "nmm:flash-" + ("off" if found[0] in DARK else "on")
    if found := numbers(tiff, entries.get(0xA403)):
        out["white_balance"] = "nmm:white-balance-" + ("auto" if found[0] == 0 else "manual")
    if 0x9286 in entries and (text := entries[0x9286][1][8:].decode("utf-8", "replace").strip("\0 ")):
        out["user_comment"] = text
    for name, ref, tag in (("latitude", 1, 2), ("longitude", 3, 4)):
        if len(found := numbers(tiff, gps.get(tag))) == 3:
            degrees = _single(found[0] + found[1] / 60 + found[2] / 3600)
            out[name] = repr(-degrees if gps.get(ref, (2, b""))[1][:1] in (b"S", b"W") else degrees)
    if found := numbers(tiff, gps.get(0x11)):
        out["direction"] = _plain(found[0])
    if found := numbers(tiff, gps.get(6)):
        out["altitude"] = repr(-_single(found[0]) if gps.get(5, (1, b"\0"))[1][:1] == b"\1" else _single(found[0]))
    return out


def iptc(data: bytes) -> dict[str, str]:
    """Datasets of record 2: the first of each counts, keywords are joined."""
    out: dict[str, str] = {}
    at = 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, tag, size = struct.unpack_from(">BBH", data, at + 1)
        name, value = IPTC_NAMES.get(tag), data[at + 5 : at + 5 + size].decode("utf-8", "replace")
        if record == 2 and name == "keywords" and name in out:
            out[name] += ", " + value
        elif record == 2 and name:
            out.setdefault(name, value)
        at += 5 + size
    if "orientation" in out:
        out["orientation"] = "nfo:orientation-" + ("left" if out["orientation"] == "P" else "top")
    if "date_created" in out:
        out["date_created"] = iso_date(out["date_created"])
    return out


def photoshop(data: bytes) -> dict[str, str]:
    """The IPTC datasets among the resources of an image editor's segment."""
    at = data.find(b"8BIM")
    while at >= 0 and data[at : at + 4] == b"8BIM" and at + 12 <= len(data):
        number, name = struct.unpack_from(">HB", data, at + 4)
        start = at + 6 + (name + 2) // 2 * 2
        if start + 4 > len(data):
            break
        size = struct.unpack_from(">I", data, start)[0]
        if number == 0x0404:
            return iptc(data[start + 4 : start + 4 + size])
        at = start + 4 + (size + 1) // 2 * 2
    return {}


def xmp(packet: bytes) -> dict[str, str]:
    """Fields of a packet; none of a broken one."""
    return packets.fields(packets.walk(packet))


# What of several sources counts, in order, by format and property.  own: the format's own fields.
_CAMERA = """
nmm:whiteBalance xmp.white_balance exif.white_balance
nmm:fnumber xmp.fnumber exif.fnumber
nmm:flash xmp.flash exif.flash
nmm:focalLength xmp.focal_length exif.focal_length
nmm:exposureTime xmp.exposure_time exif.exposure_time
nmm:isoSpeed xmp.iso_speed exif.iso_speed
nmm:meteringMode xmp.metering_mode exif.metering_mode
"""
_PLACE = """
nco:locality xmp.city iptc.city
nco:region xmp.state iptc.state
nco:streetAddress xmp.address iptc.sublocation
nco:country xmp.country iptc.country
slo:altitude xmp.altitude exif.altitude
slo:latitude xmp.latitude exif.latitude
slo:longitude xmp.longitude exif.longitude
nfo:heading xmp.direction exif.direction
nco:creator xmp.creator iptc.byline iptc.credit
"""
RANKS = {
    "jpeg": _CAMERA + _PLACE + """
nie:title xmp.title exif.document_name xmp.title2 xmp.pdf_title
nfo:orientation xmp.orientation exif.orientation iptc.orientation
nie:copyright xmp.copyright xmp.rights exif.copyright iptc.copyright
nco:contributor xmp.artist exif.artist xmp.contributor
nie:contentCreated xmp.date xmp.time_original exif.time iptc.date_created exif.time_original
nie:description xmp.description exif.description
nie:comment own.comment exif.user_comment
nfo:manufacturer xmp.make exif.make
nfo:model xmp.model exif.model
""",
    "tiff": _CAMERA + _PLACE + """
nie:title xmp.title xmp.pdf_title own.document_name exif.document_name xmp.title2
nfo:orientation xmp.orientation own.orientation exif.orientation iptc.orientation
nie:copyright xmp.rights own.copyright exif.copyright iptc.copyright
nco:contributor xmp.artist own.artist exif.artist xmp.contributor
nie:contentCreated xmp.date xmp.time_original own.time exif.time iptc.date_created exif.time_original
nie:description xmp.description own.description
nie:comment exif.user_comment
nfo:manufacturer xmp.make own.make exif.make
nfo:model xmp.model own.model exif.model
""",
    "png": _CAMERA + """
nco:creator xmp.creator own.creator own.author
nie:title xmp.title own.title exif.document_name xmp.title2 xmp.pdf_title
nfo:orientation xmp.orientation exif.orientation
nie:copyright xmp.rights own.copyright exif.copyright
nie:license xmp.license own.disclaimer
nco:contributor xmp.artist exif.artist xmp.contributor
nie:contentCreated xmp.date xmp.time_original own.creation_time exif.time exif.time_original
nie:description xmp.description own.description exif.description
nie:comment own.comment exif.user_comment
nfo:manufacturer xmp.make exif.make
nfo:model xmp.model exif.model
""",
    "gif": """
nco:creator xmp.creator
nie:title xmp.title xmp.title2 xmp.pdf_title
nie:copyright xmp.rights
nie:license xmp.license
nie:contentCreated xmp.date xmp.time_original
nie:description xmp.description
nie:comment own.comment
nfo:orientation xmp.orientation
""" + _CAMERA,
}


def rank_rows() -> list[tuple[str, str, str, int]]:
    """(module, field, source, rank) of all ranks, as ``policy.ranked`` takes them."""
    return [(module, field, source, k) for module, lines in RANKS.items() for field, *sources in map(str.split, filter(None, lines.splitlines())) for k, source in enumerate(sources)]


@cache
def _order(module: str) -> list[tuple[str, str, str]]:
    """(field, source, its key) of a module's ranks, in order."""
    return [(field, *source.split(".", 1)) for name, field, source, _ in rank_rows() if name == module]


def settled(module: str, **sources: dict[str, str]) -> dict[str, str]:
    """The properties of an image of that format by RANKS; keywords are those of all sources."""
    out: dict[str, str] = {}
    for field, kind, key in _order(module):
        if field not in out and kind in sources and (value := first(sources[kind].get(key))):
            out[field] = value
    words = ", ".join(w for kind in ("xmp", "iptc") if (w := sources.get(kind, {}).get("keywords")))
    return out | ({"nie:keyword": words} if words else {})


def image_properties(e: dict[str, str], i: dict[str, str], x: dict[str, str], comment: str | None = None, module: str = "jpeg", own: dict[str, str] | None = None) -> dict[str, str]:
    """What an image's EXIF, IPTC and XMP fields, and its format's own, say together."""
    return settled(module, exif=e, iptc=i, xmp=x, own=(own or {}) | ({"comment": comment} if comment else {}))


# Fixed values of MPEG audio: kbit/s by (version 1, layer), samples/s of version 1, samples a frame.
BIT_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Bytes searched for the first frame, and frames that must follow each other.
SYNC_BYTES, FRAMES_IN_ROW = 16_768, 2


def frame(head: bytes) -> tuple[int, int, int, int, int, int] | None:
    """(version, layer, kbit/s, samples/s, channels, bytes) of a frame's four bytes."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(head[1] >> 3 & 3), 4 - (head[1] >> 1 & 3)
    rate, speed = head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or speed == 3:
        return None
    kbits, hertz = BIT_RATES[version == 1, layer][rate - 1], RATES[speed] // {1: 1, 2: 2, 25: 4}[version]
    padded = head[2] >> 1 & 1
    size = (12_000 * kbits // hertz + padded) * 4 if layer == 1 else samples(version, layer) * 125 * kbits // hertz + padded
    return version, layer, kbits, hertz, 1 if head[3] >> 6 == 3 else 2, size


def samples(version: int, layer: int) -> int:
    return 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152


def profile(version: int, layer: int, bits: int, hertz: int, channels: int) -> str | None:
    """Media server profile of an audio stream."""
    if version == 1 and layer == 3 and 32_000 <= bits <= 320_000 and channels <= 2 and hertz in RATES:
        return "MP3"
    return "MP3X" if 8_000 <= bits <= 320_000 and version in (1, 2) else None


def audio_properties(data: bytes, start: int, size: int) -> dict[str, str]:
    """Rates, channels and seconds of the frames from ``start`` on; ``size`` is the whole file's.

    Seconds come from the count in the first frame if there is one, from the
    size if the bit rate never changes, else from the frames seen.
    """
    for at in range(start, min(start + SYNC_BYTES, len(data))):
        here, n = at, 0
        while n < FRAMES_IN_ROW and (f := frame(data[here : here + 4])):
            here, n = here + f[5], n + 1
        if n == FRAMES_IN_ROW:
            break
    else:
        return {}
    version, layer, _, hertz, channels, _ = head = frame(data[at : at + 4])
    side = (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)
    counted = None
    if data[at + 4 + side : at + 8 + side] in (b"Xing", b"Info") and len(data) >= at + 16 + side:
        flags, frames = struct.unpack_from(">II", data, at + 8 + side)
        counted = frames if flags & 1 else None
    seen, here = [], at
    while f := frame(data[here : here + 4]):
        seen.append(f[2])
        here += f[5]
    bits = sum(seen) * 1000 // len(seen)
    if counted is not None:
        seconds = counted * samples(version, layer) // hertz
    elif min(seen) == max(seen):
        seconds = (size - at) * 8 // bits
    else:
        seconds = len(seen) * samples(version, layer) // hertz
    kind = profile(*head[:2], bits, hertz, channels)
    found = {"nfo:codec": "MPEG", "nfo:averageBitrate": str(bits), "nfo:sampleRate": str(hertz), "nfo:channels": str(channels), "nfo:duration": str(seconds)}
    return found | ({"nmm:dlnaProfile": kind, "nmm:dlnaMime": "audio/mpeg"} if kind else {})


# Names of the audio genres from 0 on.
GENRES = """Blues;Classic Rock;Country;Dance;Disco;Funk;Grunge;Hip-Hop;Jazz;Metal;New Age;Oldies;Other;Pop;R&B;Rap;Reggae;Rock;Techno;Industrial;Alternative;Ska;Death Metal;Pranks;Soundtrack;Euro-Techno;Ambient;Trip-Hop;Vocal;Jazz+Funk;Fusion;Trance;Classical;Instrumental;Acid;House;Game;Sound Clip;Gospel;Noise;Alt. Rock;Bass;Soul;Punk;Space;Meditative;Instrumental Pop;Instrumental Rock;Ethnic;Gothic;Darkwave;Techno-Industrial;Electronic;Pop-Folk;Eurodance;Dream;Southern Rock;Comedy;Cult;Gangsta Rap;Top 40;Christian Rap;Pop/Funk;Jungle;Native American;Cabaret;New Wave;Psychedelic;Rave;Showtunes;Trailer;Lo-Fi;Tribal;Acid Punk;Acid Jazz;Polka;Retro;Musical;Rock & Roll;Hard Rock;Folk;Folk/Rock;National Folk;Swing;Fast-Fusion;Bebob;Latin;Revival;Celtic;Bluegrass;Avantgarde;Gothic Rock;Progressive Rock;Psychedelic Rock;Symphonic Rock;Slow Rock;Big Band;Chorus;Easy Listening;Acoustic;Humour;Speech;Chanson;Opera;Chamber Music;Sonata;Symphony;Booty Bass;Primus;Porn Groove;Satire;Slow Jam;Club;Tango;Samba;Folklore;Ballad;Power Ballad;Rhythmic Soul;Freestyle;Duet;Punk Rock;Drum Solo;A Cappella;Euro-House;Dance Hall;Goa;Drum & Bass;Club-House;Hardcore;Terror;Indie;BritPop;Negerpunk;Polsk Punk;Beat;Christian Gangsta Rap;Heavy Metal;Black Metal;Crossover;Contemporary Christian;Christian Rock;Merengue;Salsa;Thrash Metal;Anime;JPop;Synthpop""".split(";")


def genre(text: str) -> str | None:
    """Number in brackets first, else digits at the end, by the table; null beyond it, other texts as they are."""
    m = re.search(r"\(([0-9]+)\)", text) or re.search(r"([0-9]+)\Z", text)
    if m is None:
        return text
    return GENRES[int(m[1])] if int(m[1]) < len(GENRES) else None
