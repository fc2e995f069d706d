"""Metadata written into images and audio: read back, all else unchanged, originals kept on errors."""

import os
import struct
import zlib

import pytest

from sextant.operators import extract, id3, overlays, packets, writers
from sextant.plans import images

VALUES = {
    "nie:title": "A & <b>", "nco:creator": "Zoë", "nie:description": "d", "nie:copyright": "c", "nie:keyword": "one, two", "nie:contentCreated": "2020-01-02T03:04:05", "nfo:orientation": "nfo:orientation-left-mirror", "nmm:meteringMode": "nmm:metering-mode-pattern",
    "nmm:whiteBalance": "nmm:white-balance-manual", "nmm:flash": "nmm:flash-on", "nmm:focalLength": "35", "nmm:exposureTime": "0.25", "nmm:isoSpeed": "400", "nmm:fnumber": "2.8", "nfo:manufacturer": "Maker", "nfo:model": "M1",
    "nco:locality": "Oslo", "nco:region": "R", "nco:country": "Norway", "nco:streetAddress": "S 1", "slo:latitude": "-41.5", "slo:longitude": "2.25", "slo:altitude": "12.5", "nfo:heading": "90",
}


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 5, 6, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x21\xfe\x01!\0;"


@pytest.mark.parametrize("form", ["jpeg", "png", "tiff"])
@pytest.mark.parametrize("k", [1, 420])
def test_images(form, k):
    """Without and with fields that were there before."""
    old = images.build(form, k, "name", "segment", 3)
    new = writers.rewritten(f"image/{form}", old, VALUES)
    _, props, _ = getattr(extract, f"read_{form}")(new)
    known = {p for p, *_ in map(str.split, filter(None, overlays.RANKS[form].splitlines()))}
    for prop, value in VALUES.items():
        if prop in ("slo:latitude", "slo:longitude") and prop in known:
            assert float(props[prop]) == pytest.approx(float(value))
        elif prop == "nie:keyword":
            assert props[prop].startswith("one,two")
        elif prop in known:
            assert props[prop] == value
    again = writers.rewritten(f"image/{form}", new, {"nie:title": None, "nie:copyright": ""})
    _, props, _ = getattr(extract, f"read_{form}")(again)
    assert props.get("nie:title") != VALUES["nie:title"] and props["nfo:model"] == "M1"
    # Written twice is as written once.
    assert writers.rewritten(f"image/{form}", new, VALUES) == new or form == "tiff"


def test_other_bytes_stay():
    old = images.build("jpeg", 1, "n", "s", 1)
    new = writers.rewritten("image/jpeg", old, {"nie:title": "t"})
    start = new.index(b"\xff\xe1", new.index(b"Exif"))
    end = start + 2 + struct.unpack_from(">H", new, start + 2)[0]
    before = old.index(b"\xff\xe1", old.index(b"Exif"))
    after = before + 2 + struct.unpack_from(">H", old, before + 2)[0]
    assert new[:start] == old[:before] and new[end:] == old[after:]
    png = images.build("png", 1, "n", "s", 1)
    chunks = lambda data: [(data[a + 4 : a + 8], data[a : a + 12 + n]) for a, n in places(data)]

    def places(data):
        at = 8
        while at < len(data):
            n = struct.unpack_from(">I", data, at)[0]
            yield at, n
            at += 12 + n

    new = writers.rewritten("image/png", png, {"nie:title": "t"})
    assert [c for k, c in chunks(new) if k != b"iTXt"] == [c for k, c in chunks(png) if k != b"iTXt"]
    assert all(zlib.crc32(c[4:-4]) == struct.unpack(">I", c[-4:])[0] for _, c in chunks(new))
    tiff = images.build("tiff", 1, "n", "s", 1)
    new = writers.rewritten("image/tiff", tiff, {"nie:title": "t"})
    assert sum(a != b for a, b in zip(tiff, new, strict=False)) <= 12  # one entry of the directory


def test_gif_and_tiff_without_packet():
    new = writers.rewritten("image/gif", gif(), {"nie:title": "t"})
    assert extract.read_gif(new)[1] == {"nie:title": "t", "nie:comment": "!", "nfo:width": "5", "nfo:height": "6"}
    assert extract.read_gif(writers.rewritten("image/gif", new, {"nie:title": "u"}))[1]["nie:title"] == "u"
    plain = images.directory([(0x0100, 4, struct.pack("<I", 7)), (0x0101, 4, struct.pack("<I", 9)), (0x010F, 2, b"maker of cameras\0")])
    props = extract.read_tiff(writers.rewritten("image/tiff", plain, {"nie:title": "t"}))[1]
    assert props == {"nie:title": "t", "nfo:manufacturer": "maker of cameras", "nfo:width": "7", "nfo:height": "9"}


def test_packets_keep_what_they_do_not_write():
    packet = images.packet("<dc:title>old</dc:title><mwg-rs:Regions rdf:parseType='Resource'><mwg-rs:RegionList><rdf:Bag><rdf:li rdf:parseType='Resource'><mwg-rs:Name>N</mwg-rs:Name></rdf:li></rdf:Bag></mwg-rs:RegionList></mwg-rs:Regions>")
    rows = packets.walk(writers.edited(packet, {"nie:title": "new"}))
    assert packets.regions(rows) == [{"title": "N"}] and packets.fields(rows)["title"] == "new" and not any(v == "old" for _, v in rows)
    assert packets.fields(packets.walk(writers.edited(b"<broken", {"nco:creator": "x"}))) == {"creator": "x"}


def audio():
    return (b"\xff\xfb\x90\x00" + b"\0" * 413) * 3


def test_audio_tags():
    values = {"nie:title": "Tïtle", "nmm:performer": "P", "nmm:albumArtist": "AA", "nmm:musicAlbum": "A", "nfo:genre": "Rock", "nmm:trackNumber": "3", "nmm:setNumber": "1", "nie:contentCreated": "2020", "nmm:composer": "C", "nco:publisher": "Pub", "nie:copyright": "©", "nmm:internationalStandardRecordingCode": "NO123", "nie:description": "D", "nie:comment": "Co", "nmm:lyrics": "La\nla", "nie:keyword": "a,b", "musicbrainz:artist": "id-1", "nie:hasArtwork": b"\xff\xd8\xff\xe0picture\xff\x00\xff"}
    new = writers.rewritten("audio/mpeg", audio(), values)
    props = extract.read_mp3(new)[1]
    assert {k: props[k] for k in values} == values | {"nie:hasArtwork": "image/jpeg"} and new.endswith(audio()) and props["nfo:sampleRate"] == "44100"
    size = id3.tag_size(new)
    assert not any(new[i] == 0xFF and new[i + 1] >= 0xE0 for i in range(size - 1))  # nothing looks like audio
    shorter = writers.rewritten("audio/mpeg", new, {"nie:title": "T", "nmm:lyrics": None})
    assert len(shorter) == len(new) and shorter[size:] == new[size:]  # in the old tag's place
    props = extract.read_mp3(shorter)[1]
    assert props["nie:title"] == "T" and "nmm:lyrics" not in props and props["musicbrainz:artist"] == "id-1" and props["nie:hasArtwork"] == "image/jpeg"
    bare = writers.rewritten("audio/mpeg", new, dict.fromkeys(values))
    assert bare == audio()
    picture = dict(id3.frames(new))["APIC"]
    assert picture.endswith(values["nie:hasArtwork"])


def test_older_versions_are_kept():
    frame = lambda name, text: name + struct.pack(">I", len(text) + 1) + b"\0\0\0" + text
    body = frame(b"TYER", b"1999") + frame(b"TCOM", b"someone") + frame(b"ZZZZ", b"unknown")
    old = b"ID3\3\0\0" + id3.synchsafe(len(body)) + body + audio()
    new = writers.rewritten("audio/mpeg", old, {"nie:title": "t"})
    props = extract.read_mp3(new)[1]
    assert (props["nie:title"], props["nmm:composer"], props["nie:contentCreated"]) == ("t", "someone", "1999") and ("ZZZZ", b"\0unknown") in list(id3.frames(new))
    data = b"\xff\xe0\xff\x00\xff"
    assert id3.synchronised(id3.unsynchronised(data)).rstrip(b"\0") == data.rstrip(b"\0") or id3.synchronised(id3.unsynchronised(data))[: len(data)] == data


def test_files(spark, tmp_path):
    """What fails leaves its file, and nothing else lies around."""
    good, wrong, locked = (tmp_path / n for n in ("good.png", "wrong.png", "absent.png"))
    good.write_bytes(images.build("png", 1, "n", "s", 1))
    wrong.write_bytes(b"GIF89a no image")
    os.chmod(good, 0o640)
    rows = [(f"file://{good}", "image/png", {"nie:title": "t"}), (str(wrong), "image/png", {"nie:title": "t"}), (str(locked), "image/png", {"nie:title": "t"}), (f"{good}", "application/pdf", {"nie:title": "x"}), (f"{good}", "image/png", {"no:such": "x"})]
    found = writers.write_back(spark.createDataFrame(rows, "path string, mime string, props map<string,string>").coalesce(1)).collect()
    assert [r.written for r in found] == [True, False, False, False, False]
    assert [(r.error or "").split(":")[0] for r in found] == ["", "ValueError", "PermissionError", "ValueError", "ValueError"]
    assert extract.read_png(good.read_bytes())[1]["nie:title"] == "t" and wrong.read_bytes() == b"GIF89a no image" and sorted(p.name for p in tmp_path.iterdir()) == ["good.png", "wrong.png"]
    assert good.stat().st_mode & 0o777 == 0o640
