"""XMP packets: a walk over nested structures and lists, the fields found by their paths, and image regions.

``walk`` turns a packet into rows of path and value, one for each simple value,
such as ``mwg-rs:Regions/mwg-rs:RegionList[2]/mwg-rs:Area/stArea:x``; what a
reader wants is then looked up by path, whatever way the packet was written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

from sextant.functions.media import METERING, ORIENTATIONS
from sextant.functions.media import REGIONS as KINDS

RDF, XML = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"
# Namespaces and the prefixes of paths.
PREFIXES = {
    "http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/exif/1.0/": "exif", "http://cipa.jp/exif/1.0/": "exifEX", "http://ns.adobe.com/tiff/1.0/": "tiff", "http://ns.adobe.com/pdf/1.3/": "pdf",
    "http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/photoshop/1.0/": "photoshop", "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/": "Iptc4xmpCore", "http://creativecommons.org/ns#": "cc", "http://web.resource.org/cc/": "cc",
    "http://www.metadataworkinggroup.com/schemas/regions/": "mwg-rs", "http://ns.adobe.com/xmp/sType/Area#": "stArea", "http://ns.adobe.com/xap/1.0/sType/Dimensions#": "stDim",
}
# Paths of fields, in lower case, without list numbers.  Of several paths the first in the packet counts.
FIELDS = {
    "title": "dc:title", "title2": "exif:title", "pdf_title": "pdf:title", "rights": "dc:rights", "copyright": "exif:copyright tiff:copyright", "creator": "dc:creator", "description": "dc:description", "contributor": "dc:contributor",
    "publisher": "dc:publisher", "date": "dc:date", "time_original": "exif:datetimeoriginal", "artist": "exif:artist tiff:artist", "make": "exif:make tiff:make", "model": "exif:model tiff:model", "license": "cc:license", "rating": "xmp:rating",
    "orientation": "tiff:orientation", "flash": "exif:flash exif:flash/exif:fired", "metering_mode": "exif:meteringmode", "white_balance": "exif:whitebalance", "exposure_time": "exif:exposuretime", "fnumber": "exif:fnumber", "focal_length": "exif:focallength",
    "iso_speed": "exif:isospeedratings", "altitude": "exif:gpsaltitude", "latitude": "exif:gpslatitude", "longitude": "exif:gpslongitude", "direction": "exif:gpsimgdirection",
    "city": "photoshop:city iptc4xmpcore:city", "state": "photoshop:state iptc4xmpcore:state iptc4xmpcore:province", "address": "photoshop:location iptc4xmpcore:location iptc4xmpcore:sublocation",
    "country": "photoshop:country iptc4xmpcore:country iptc4xmpcore:countryname iptc4xmpcore:primarylocationname",
}
FIELD_OF = {path: field for field, paths in FIELDS.items() for path in paths.split()}
KEYWORDS = ("dc:subject", "dc:keywords", "pdf:keywords")
# Fields of a region by the end of their path.
REGION = {"mwg-rs:name": "title", "mwg-rs:description": "description", "mwg-rs:type": "type", "starea:x": "x", "starea:y": "y", "starea:w": "width", "starea:h": "height"}
REGIONS = "mwg-rs:Regions/mwg-rs:RegionList"


def _name(tag: str) -> str:
    uri, _, local = tag[1:].rpartition("}") if tag[:1] == "{" else ("", "", tag)
    return f"{PREFIXES.get(uri, uri)}:{local}" if uri else local


def _fields(node: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """Attributes that are properties."""
    for key, value in node.attrib.items():
        if key[:1] == "{" and not key.startswith((RDF, XML)):
            yield _name(key), value


def walk(packet: bytes) -> list[tuple[str, str]]:
    """(path, value) of every simple value of a packet, in its order; none of a broken one.

    Items of lists are numbered from 1.  Of a list of alternatives the one
    marked as default comes first, and so has the number 1.
    """
    try:
        root = ElementTree.fromstring(packet.strip(b"\0 \r\n\t"))
    except ElementTree.ParseError:  # a broken packet says nothing; the image stands
        return []
    out: list[tuple[str, str]] = []
    tops = [e for rdf in root.iter(RDF + "RDF") for e in rdf if e.tag == RDF + "Description"] or list(root.iter(RDF + "Description"))[:1]
    # Structures may be nested as deeply as a packet is long, so the walk keeps its own stack.
    todo = [("", e) for e in reversed(tops)]
    while todo:
        path, node = todo.pop()
        at = lambda name, path=path: f"{path}/{name}" if path else name
        own = list(_fields(node))
        out += [(at(name), value) for name, value in own]
        lists = [e for e in node if e.tag in (RDF + "Bag", RDF + "Seq", RDF + "Alt")]
        inner = [e for e in node if e.tag == RDF + "Description"]
        if lists and path:
            items = [e for e in lists[0] if e.tag == RDF + "li"]
            if lists[0].tag == RDF + "Alt":
                items.sort(key=lambda e: e.get(XML + "lang") != "x-default")
            todo += [(f"{path}[{k}]", e) for k, e in reversed(list(enumerate(items, 1)))]
        elif inner and path:
            todo += [(path, e) for e in reversed(inner)]
        elif len(node):
            todo += [(at(_name(e.tag)), e) for e in reversed(node)]
        elif path and node.get(RDF + "resource") is not None:
            out.append((path, node.get(RDF + "resource")))
        elif path and not own:
            out.append((path, (node.text or "").strip()))
    return out


def _whole(text: str) -> int:
    m = re.match(r"\s*([+-]?\d+)", text)
    return int(m[1]) if m else 0


def _ratio(text: str) -> str | None:
    a, slash, b = text.partition("/")
    if not slash:
        return text
    x = _whole(a) / _whole(b) if _whole(b) else None
    return None if x is None else str(int(x)) if x == int(x) else repr(x)


def _place(text: str) -> str | None:
    """Degrees and decimal minutes with their half of the earth."""
    m = re.search(r"([0-9]+),([0-9]+.[0-9]+)([A-Z])", text)
    if not m:
        return None
    degrees = int(m[1]) + float(re.match(r"[0-9]+(?:\.[0-9]+)?", m[2])[0]) / 60
    return repr(-degrees if m[3] in "SW" else degrees)


# Orientations by their number in a packet, where 3 and 4 stand the other way round than in EXIF.
TURNED = (*ORIENTATIONS[:2], ORIENTATIONS[3], ORIENTATIONS[2], *ORIENTATIONS[4:])
CONVERT = {
    "orientation": lambda v: "nfo:orientation-" + (TURNED[int(v) - 1] if v in "12345678" and len(v) == 1 else "top"),
    "flash": lambda v: "nmm:flash-" + ("on" if _whole(v) & 1 or v.lower() == "true" else "off"),
    "metering_mode": lambda v: "nmm:metering-mode-" + (METERING[_whole(v)] if 0 <= _whole(v) < len(METERING) else "other"),
    "white_balance": lambda v: "nmm:white-balance-" + ("manual" if v == "1" else "auto"),
    **dict.fromkeys(("exposure_time", "fnumber", "focal_length", "iso_speed", "altitude", "direction"), _ratio),
    **dict.fromkeys(("latitude", "longitude"), _place),
}


def fields(rows: list[tuple[str, str]]) -> dict[str, str]:
    """Fields by FIELDS of the rows of a walk; keywords are joined by commas."""
    out: dict[str, str] = {}
    words: list[str] = []
    for path, value in rows:
        plain, value = re.sub(r"\[\d+\]", "", path).lower(), value.strip()
        if not value:
            continue
        if plain in KEYWORDS:
            words.append(value)
        elif (name := FIELD_OF.get(plain)) and name not in out and (found := CONVERT.get(name, str)(value)):
            out[name] = found
    return out | ({"keywords": ",".join(words)} if words else {})


def regions(rows: list[tuple[str, str]]) -> list[dict[str, str]]:
    """The regions of an image in their order; each has what the packet says of title, type, area and what it refers to."""
    found: dict[int, dict[str, str]] = {}
    for path, value in rows:
        m = re.match(re.escape(REGIONS) + r"\[(\d+)\]/(.+)", path)
        if not m:
            continue
        region, last = found.setdefault(int(m[1]), {}), m[2].rpartition("/")[2]
        if m[2].startswith("mwg-rs:Extensions"):
            region.setdefault("link_class", last)
            region.setdefault("link", value)
        elif last.lower() in REGION and value:
            region.setdefault(REGION[last.lower()], value)
    for region in found.values():
        if "type" in region:
            kind = next((r for r in KINDS if region["type"].lower().startswith(r)), "undefined")
            region["type"] = f"nfo:roi-content-{kind}"
    return [found[k] for k in sorted(found)]
