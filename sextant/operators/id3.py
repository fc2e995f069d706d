"""ID3v2 tags: frames read from versions 2.2 to 2.4, and tags of version 2.4 written."""

from __future__ import annotations

from collections.abc import Iterator

# Text frames and the properties they are; names of version 2.2.
FRAMES = {
    "TIT2": "nie:title", "TPE1": "nmm:performer", "TPE2": "nmm:albumArtist", "TALB": "nmm:musicAlbum", "TCON": "nfo:genre", "TRCK": "nmm:trackNumber", "TPOS": "nmm:setNumber", "TYER": "nie:contentCreated", "TDRC": "nie:contentCreated",
    "TCOM": "nmm:composer", "TPUB": "nco:publisher", "TCOP": "nie:copyright", "TSRC": "nmm:internationalStandardRecordingCode", "TIT3": "nie:description",
}
OLD_FRAMES = {"TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TCO": "TCON", "TRK": "TRCK", "TPA": "TPOS", "TYE": "TYER", "TCM": "TCOM", "TPB": "TPUB", "TCR": "TCOP", "TRC": "TSRC", "TT3": "TIT3", "COM": "COMM", "ULT": "USLT", "TXX": "TXXX", "PIC": "APIC"}
# Frames with a language and a name, and properties of user frames by their name.
TOLD = {"COMM": "nie:comment", "USLT": "nmm:lyrics"}
USER = {"keywords": "nie:keyword", "musicbrainz artist id": "musicbrainz:artist", "musicbrainz album id": "musicbrainz:release", "musicbrainz release group id": "musicbrainz:release-group", "musicbrainz release track id": "musicbrainz:track", "acoustid fingerprint": "acoustid:fingerprint"}
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
#: Bytes left free in a new tag, so that later ones fit in its place.
PADDING = 1024


def synchsafe(n: int) -> bytes:
    """A number of 28 bits in four bytes of seven."""
    if not 0 <= n < 1 << 28:
        raise ValueError(f"too large for a tag: {n}")
    return bytes(n >> 7 * (3 - i) & 127 for i in range(4))


def number(data: bytes) -> int:
    return sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data[:4]))


def unsynchronised(data: bytes) -> bytes:
    """No byte pair looks like the start of an audio frame."""
    out = data.replace(b"\xff\x00", b"\xff\x00\x00")
    for b in range(0xE0, 0x100):
        out = out.replace(bytes([0xFF, b]), bytes([0xFF, 0, b]))
    return out + b"\0" if out.endswith(b"\xff") else out


def synchronised(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


def tag_size(data: bytes) -> int:
    """Bytes of the tag at the beginning, its header and footer included; 0 if there is none."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    return 10 + number(data[6:10]) + (10 if data[5] & 0x10 else 0)


def frames(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name as in version 2.4, body) of the frames of the tag at the beginning."""
    if data[:3] != b"ID3" or len(data) < 10:
        return
    version, flags = data[3], data[5]
    body = data[10 : 10 + number(data[6:10])]
    if flags & 0x80 and version < 4:
        body = synchronised(body)
    at = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = number(body) if version == 4 else 4 + int.from_bytes(body[:4])
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        name = body[at : at + name_size].decode("latin-1")
        raw = body[at + name_size : at + name_size + (3 if version == 2 else 4)]
        length = number(raw) if version == 4 else int.from_bytes(raw)
        value = body[at + head : at + head + length]
        if version == 4 and (body[at + 9] & 2 or flags & 0x80):
            value = synchronised(value)
        if version == 4 and body[at + 9] & 1:
            value = value[4:]  # a frame that tells its length before
        if not (version > 2 and body[at + 9] & 0x0C):  # neither packed nor encrypted
            yield OLD_FRAMES.get(name, name), value
        at += head + length


def _split(encoding: int, data: bytes) -> tuple[str, str]:
    """(name, value) of a text with a name before it."""
    text = data.decode(ENCODINGS[encoding], "replace") if encoding != 1 else None
    if text is None:
        end = next((k for k in range(0, len(data) - 1, 2) if data[k : k + 2] == b"\0\0"), len(data))
        return data[:end].decode("utf-16", "replace"), data[end + 2 :].decode("utf-16", "replace").strip("\0 ")
    name, _, value = text.partition("\0")
    return name.strip("﻿"), value.strip("\0 ﻿")


def properties(data: bytes) -> dict[str, str]:
    """What the frames say; the first of each property counts."""
    out: dict[str, str] = {}
    for name, body in frames(data):
        if not body or body[0] > 3:
            continue
        if name in FRAMES:
            out.setdefault(FRAMES[name], body[1:].decode(ENCODINGS[body[0]], "replace").strip("\0 "))
        elif name in TOLD:
            out.setdefault(TOLD[name], _split(body[0], body[4:])[1])
        elif name == "TXXX":
            key, value = _split(body[0], body[1:])
            if prop := USER.get(key.lower()):
                out.setdefault(prop, value)
        elif name == "APIC" and data[3] > 2:
            mime, _, rest = body[1:].partition(b"\0")
            if rest:
                out.setdefault("nie:hasArtwork", mime.decode("latin-1"))
    return out


def frame(name: str, body: bytes) -> bytes:
    """A frame of version 2.4; unsynchronised if its bytes could be taken for audio."""
    safe = unsynchronised(body)
    if safe == body:
        return name.encode("latin-1") + synchsafe(len(body)) + b"\0\0" + body
    return name.encode("latin-1") + synchsafe(len(safe) + 4) + b"\0\3" + synchsafe(len(body)) + safe


def bodies(values: dict[str, str | bytes | None]) -> list[tuple[str, bytes]]:
    """(name, body) of frames for properties; artwork is an image's bytes."""
    names = {prop: name for name, prop in FRAMES.items() if name != "TYER"}
    told, user = {p: n for n, p in TOLD.items()}, {p: n for n, p in USER.items()}
    out = []
    for prop, value in values.items():
        if value in (None, ""):
            continue
        if prop == "nie:hasArtwork" and isinstance(value, bytes):
            mime = b"image/png" if value[:4] == b"\x89PNG" else b"image/jpeg"
            out.append(("APIC", b"\0" + mime + b"\0\3\0" + value))
        elif prop in names:
            out.append((names[prop], b"\3" + value.encode()))
        elif prop in told:
            out.append((told[prop], b"\3und\0" + value.encode()))
        elif prop in user:
            out.append(("TXXX", b"\3" + user[prop].encode() + b"\0" + value.encode()))
        else:
            raise ValueError(f"no frame for {prop}")
    return out


def _key(name: str, body: bytes) -> str:
    """Frames with the same key stand for the same property."""
    if name == "TXXX" and body and body[0] < 4:
        return "TXXX " + _split(body[0], body[1:])[0].lower()
    return "TDRC" if name == "TYER" else name


def written(data: bytes, values: dict[str, str | bytes | None]) -> bytes:
    """The file with a tag that says ``values``; an empty value takes a property away, other frames and the audio stay.

    A tag that fits takes the place of the old one, so the audio isn't moved.
    """
    size = tag_size(data)
    new = bodies(values)
    user = {p: n for n, p in USER.items()}
    gone = {_key(*f) for f in new} | {f"TXXX {user[p]}" for p in values if p in user} | {n for n, p in (FRAMES | TOLD).items() if p in values and n != "TYER"} | ({"APIC"} if "nie:hasArtwork" in values else set())
    old = [f for f in frames(data) if _key(*f) not in gone and not (data[3] == 2 and f[0] == "APIC")]
    packed = b"".join(frame("TDRC" if name == "TYER" else name, body) for name, body in [*new, *old] if len(name) == 4)
    # A footer would have to be moved with the tag's end, so there is none.
    room = size - 10 if size >= 10 + len(packed) else len(packed) + PADDING
    if not packed:
        return data[size:]
    return b"ID3\4\0\0" + synchsafe(room) + packed + b"\0" * (room - len(packed)) + data[size:]


def check(data: bytes) -> None:
    """An error unless the file begins with a tag or an audio frame."""
    if data[:3] != b"ID3" and not (len(data) > 1 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        raise ValueError("not an MPEG audio file")
