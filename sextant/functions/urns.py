"""Deterministic identifiers of shared entities: the join keys of the index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.strings import urn_escape


def _urn(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit("urn"), F.lit(kind), *parts)


def artist(name: Column) -> Column:
    return _urn("artist", urn_escape(name))


def contact(name: Column) -> Column:
    return _urn("contact", urn_escape(name))


def tag(label: Column) -> Column:
    return _urn("tag", urn_escape(label))


def equipment(make: Column, model: Column) -> Column:
    """Missing parts are empty."""
    empty = lambda c: F.coalesce(urn_escape(c), F.lit(""))
    return F.concat(_urn("equipment", empty(make), empty(model)), F.lit(":"))


def external(source: Column, identifier: Column, uri: Column) -> Column:
    """The given uri, else one made of source and identifier."""
    return F.coalesce(uri, _urn("ExternalReference", source, identifier))


def _album_key(title: Column, artist_name: Column, date: Column) -> Column:
    return F.concat_ws(":", urn_escape(title), urn_escape(artist_name), F.substring(date, 1, 10))


def album(title: Column, artist_name: Column, date: Column) -> Column:
    """Title, and artist and day where there are any."""
    return _urn("album", _album_key(title, artist_name, date))


def album_disc(title: Column, artist_name: Column, date: Column, disc: Column) -> Column:
    return F.concat(_urn("album-disc", _album_key(title, artist_name, date)), F.lit(":Disc"), F.coalesce(disc, F.lit(1)).cast("string"))


def content(path: Column, mtime: Column) -> Column:
    """Where storage has no inodes: a digest of the place and the time of change."""
    return _urn("fileid", F.sha2(F.concat_ws("\n", path, mtime.cast("string")), 256))
