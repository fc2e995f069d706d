"""Image and audio metadata: bytes made here, fields read back."""

import struct
import zlib

import pytest

from sextant.operators import extract, overlays, packets
from sextant.plans import images


def tiff(order, entries, at=8):
    """A directory at ``at``; long values follow it. entries: tag, type, count, bytes."""
    heap, rows = b"", []
    start = at + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        if len(value) > 4:
            rows.append(struct.pack(order + "HHII", tag, kind, count, start + len(heap)))
            heap += value
        else:
            rows.append(struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0"))
    return struct.pack(order + "H", len(rows)) + b"".join(rows) + b"\0" * 4 + heap


def image(order):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    fraction = lambda *v: struct.pack(order + "II" * (len(v) // 2), *v)
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, fraction(41, 1, 30, 1, 0, 1)), (3, 2, 2, b"E\0"), (4, 5, 3, fraction(2, 1, 15, 1, 0, 1)), (5, 1, 1, b"\1"), (6, 5, 1, fraction(25, 2))]
    sub = [(0x829A, 5, 1, fraction(1, 4)), (0x829D, 5, 1, fraction(28, 0)), (0x8827, 3, 1, struct.pack(order + "H", 400)), (0x9207, 3, 1, struct.pack(order + "H", 3)), (0x9209, 3, 1, struct.pack(order + "H", 1)), (0xA403, 3, 1, struct.pack(order + "H", 0))]
    main = lambda a, b: [(0x0100, 4, 1, struct.pack(order + "I", 640)), (0x0101, 3, 1, struct.pack(order + "H", 480)), (0x0110, 2, 6, b"Camera"), (0x0112, 3, 1, struct.pack(order + "H", 6)), (0x0132, 2, 20, b"2020:01:02 03:04:05\0"), (0x8769, 4, 1, struct.pack(order + "I", a)), (0x8825, 4, 1, struct.pack(order + "I", b))]
    size = len(tiff(order, main(0, 0)))
    second = tiff(order, sub, 8 + size)
    return head + tiff(order, main(8 + size, 8 + size + len(second))) + second + tiff(order, gps, 8 + size + len(second))


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_directories(order):
    props = extract.read_tiff(image(order))[1]
    assert props == {
        "nfo:width": "640", "nfo:height": "480", "nfo:model": "Camera", "nfo:orientation": "nfo:orientation-right", "nie:contentCreated": "2020-01-02T03:04:05",
        "nmm:exposureTime": "0.25", "nmm:isoSpeed": "400", "nmm:meteringMode": "nmm:metering-mode-spot", "nmm:flash": "nmm:flash-on", "nmm:whiteBalance": "nmm:white-balance-auto",
        "slo:latitude": "-41.5", "slo:longitude": "2.25", "slo:altitude": "-12.5",
    }


def test_cut_tiff_is_an_error_or_partial():
    whole = image("<")
    for n in range(8, len(whole), 7):
        try:
            extract.read_tiff(whole[:n])
        except (ValueError, struct.error):
            pass
    with pytest.raises(ValueError):
        extract.read_tiff(b"GIF89a")


def dataset(tag, value, record=2):
    return struct.pack(">BBBH", 0x1C, record, tag, len(value)) + value


def test_datasets():
    data = dataset(90, b"\x1b%G", record=1) + dataset(25, b"a") + dataset(25, b"b") + dataset(80, b"first") + dataset(80, b"second") + dataset(55, b"2007 04 15") + dataset(131, b"P")
    assert overlays.iptc(data) == {"keywords": "a, b", "byline": "first", "date_created": "2007-04-15T00:00:00", "orientation": "nfo:orientation-left"}
    assert overlays.iptc(b"") == {}
    # A named resource of odd size comes before the one that counts.
    other = b"8BIM" + struct.pack(">H", 1000) + b"\x03abc" + struct.pack(">I", 3) + b"xyz\0"
    assert overlays.photoshop(other + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(data)) + data)["byline"] == "first"


PACKET = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:tiff="http://ns.adobe.com/tiff/1.0/">
<rdf:Description tiff:Make="Maker"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">A title</rdf:li></rdf:Alt></dc:title><dc:subject><rdf:Bag><rdf:li>k1</rdf:li><rdf:li>k2</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>"""


def test_packets_and_ranks():
    x = overlays.xmp(PACKET)
    assert x == {"make": "Maker", "title": "A title", "keywords": "k1,k2"}
    assert overlays.xmp(b"<broken") == {}
    props = overlays.image_properties({"make": "E", "document_name": "d", "user_comment": "u", "time_original": "o"}, {"credit": "c", "byline": " ", "date_created": "i"}, x, comment="")
    assert props == {"nfo:manufacturer": "Maker", "nie:title": "A title", "nie:keyword": "k1,k2", "nco:creator": "c", "nie:comment": "u", "nie:contentCreated": "i"}
    segment = b"http://ns.adobe.com/xap/1.0/\0" + PACKET
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + len(segment)) + segment
    assert extract.read_jpeg(jpeg)[1]["nie:title"] == "A title"


def test_audio_frames():
    constant = (b"\xff\xfb\x90\x00" + b"\0" * 413) * 100  # 128 kbit/s, 417 bytes each
    found = overlays.audio_properties(b"junk" + constant, 0, 4 + len(constant))
    assert (found["nfo:duration"], found["nfo:averageBitrate"], found["nfo:channels"], found["nmm:dlnaProfile"]) == ("2", "128000", "2", "MP3")
    mixed = constant + (b"\xff\xfb\xb0\xc0" + b"\0" * 622) * 100  # 192 kbit/s
    assert overlays.audio_properties(mixed, 0, len(mixed))["nfo:duration"] == str(200 * 1152 // 44100)
    assert overlays.audio_properties(b"\xff" * 20_000, 0, 20_000) == {}
    assert overlays.audio_properties(b"", 0, 0) == {}


def test_genres():
    assert [overlays.genre(g) for g in ("(17)", "Rock", "(4)Eurodisco", "13", "(255)")] == ["Rock", "Rock", "Disco", "Pop", None]


REGIONS = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:mwg-rs="http://www.metadataworkinggroup.com/schemas/regions/" xmlns:stArea="http://ns.adobe.com/xmp/sType/Area#" xmlns:dc="http://purl.org/dc/elements/1.1/">
<rdf:RDF><rdf:Description rdf:about="" dc:title="t"><mwg-rs:Regions rdf:parseType="Resource"><mwg-rs:AppliedToDimensions stArea:w="9"/><mwg-rs:RegionList><rdf:Bag>
<rdf:li><rdf:Description mwg-rs:Name="Ann" mwg-rs:Type="Face"><mwg-rs:Area stArea:x="0.1" stArea:y="0.2" stArea:w="0.3" stArea:h="0.4" stArea:unit="normalized"/><mwg-rs:Extensions rdf:parseType="Resource"><dc:subject rdf:resource="urn:contact:1"/></mwg-rs:Extensions></rdf:Description></rdf:li>
<rdf:li rdf:parseType="Resource"><mwg-rs:Type>BarCode42</mwg-rs:Type><mwg-rs:Area rdf:parseType="Resource"><stArea:x>0.5</stArea:x></mwg-rs:Area><mwg-rs:Description>code</mwg-rs:Description></rdf:li>
</rdf:Bag></mwg-rs:RegionList></mwg-rs:Regions></rdf:Description></rdf:RDF></x:xmpmeta>"""


def test_walk_and_regions():
    rows = packets.walk(REGIONS)
    assert ("mwg-rs:Regions/mwg-rs:RegionList[1]/mwg-rs:Area/stArea:x", "0.1") in rows and ("mwg-rs:Regions/mwg-rs:AppliedToDimensions/stArea:w", "9") in rows and ("dc:title", "t") in rows
    assert packets.regions(rows) == [
        {"title": "Ann", "type": "nfo:roi-content-face", "x": "0.1", "y": "0.2", "width": "0.3", "height": "0.4", "link_class": "dc:subject", "link": "urn:contact:1"},
        {"type": "nfo:roi-content-barcode", "x": "0.5", "description": "code"},
    ]
    deep = b'<x:xmpmeta xmlns:x="a" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><rdf:RDF><rdf:Description>' + b"<dc:a rdf:parseType='Resource'>" * 3000 + b"<dc:b>x</dc:b>" + b"</dc:a>" * 3000 + b"</rdf:Description></rdf:RDF></x:xmpmeta>"
    assert packets.walk(deep) == [("/".join(["dc:a"] * 3000 + ["dc:b"]), "x")]
    assert packets.walk(b"<broken") == [] and packets.walk(b"") == []


def test_fields_of_packets():
    inner = "<exif:FNumber>28/10</exif:FNumber><exif:ExposureTime>1/0</exif:ExposureTime><exif:GPSLatitude>41,30.5N</exif:GPSLatitude><exif:GPSLongitude>2,15.0W</exif:GPSLongitude><exif:MeteringMode>5</exif:MeteringMode><exif:WhiteBalance>1</exif:WhiteBalance><exif:Flash>16</exif:Flash><tiff:Orientation>3</tiff:Orientation><exif:GPSAltitude>25/2</exif:GPSAltitude>"
    assert overlays.xmp(images.packet(inner)) == {
        "fnumber": "2.8", "latitude": repr(41 + 30.5 / 60), "longitude": "-2.25", "metering_mode": "nmm:metering-mode-pattern", "white_balance": "nmm:white-balance-manual", "flash": "nmm:flash-off", "orientation": "nfo:orientation-bottom", "altitude": "12.5",
    }


def test_png_texts():
    profile = b"exif\n" + str(len(image("<")) + 6).encode() + b"\n" + (b"Exif\0\0" + image("<")).hex().encode()
    parts = [images.chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0)), images.chunk(b"zTXt", b"Raw profile type exif\0\0" + zlib.compress(profile)), images.chunk(b"tEXt", b"Author\0Zo\xeb"), images.chunk(b"iTXt", b"Comment\0\0\0en\0Comment\0caf\xc3\xa9"), images.chunk(b"zTXt", b"Title\0\0broken")]
    props = extract.read_png(b"\x89PNG\r\n\x1a\n" + b"".join(parts))[1]
    assert props["nfo:model"] == "Camera" and props["nco:creator"] == "Zoë" and props["nie:comment"] == "café" and props["nfo:width"] == "3" and "nie:title" not in props


def test_gif_blocks():
    long = b"c" * 300
    comment = b"\x21\xfe\xff" + long[:255] + b"\x2d" + long[255:] + b"\0"
    trailer = bytes([1, *range(255, -1, -1), 0])
    packet = b"\x21\xff\x0bXMP DataXMP" + PACKET + trailer
    picture = b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0"
    head = b"GIF89a" + struct.pack("<HHBBB", 5, 6, 0x80, 0, 0) + b"\0" * 6
    props = extract.read_gif(head + packet + picture + comment + b"\x21\xfe\x01!\0;")[1]
    assert props == {"nfo:width": "5", "nfo:height": "6", "nie:title": "A title", "nie:keyword": "k1,k2", "nie:comment": "c" * 300 + "!"}
    assert extract.read_gif(head + b";")[1] == {"nfo:width": "5", "nfo:height": "6"}


def test_broken_segments_cost_their_own_fields():
    mark = lambda code, body: b"\xff" + bytes([code]) + struct.pack(">H", len(body) + 2) + body
    jpeg = b"\xff\xd8" + mark(0xE1, b"Exif\0\0II") + mark(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + PACKET) + mark(0xC0, struct.pack(">BHHB", 8, 7, 9, 1))
    props = extract.read_jpeg(jpeg)[1]
    assert (props["nfo:width"], props["nie:title"]) == ("9", "A title")
