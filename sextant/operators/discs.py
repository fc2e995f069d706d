"""Games on disc images: what a cue sheet's data track holds.

A raw image is frames of 2,352 bytes.  For one console the volume descriptor
leads to the root directory, where a start file names the program; it counts
only if the program is there.  For the other a text stands at a fixed place of
the image.  Images are looked at where they lie: only a few frames are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.paths import base_name, parent
from sextant.functions.tables import map_batches

# Sizes of a frame and its parts, places in the volume, and names of files and systems.
FRAME, HEAD, CONTENT, DESCRIPTOR, ROOT, DIRECTORY = 2352, 24, 2048, 16, 156, 0x2
START, DEFAULT, DEVICE = b"SYSTEM.CNF;1", b"PSX.EXE;1", b"cdrom:"
OTHER_AT, OTHER = 0x81C90, b"PC Engine CD-ROM SYSTEM"
RAW_MODES = ("MODE1/2352", "MODE2/2352")


def content(image: bytes, block: int) -> bytes | None:
    """The 2,048 bytes of a block; null beyond the end."""
    at = block * FRAME + HEAD
    return image[at : at + CONTENT] if 0 <= block and (block + 1) * FRAME <= len(image) else None


def entries(directory: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, first block, flags) of the records of a directory."""
    at = 0
    while at + 33 < len(directory) and directory[at]:
        size = directory[at]
        yield directory[at + 33 : at + size], int.from_bytes(directory[at + 2 : at + 6], "little", signed=True), directory[at + 25]
        at += size


def find(directory: bytes, name: bytes) -> int | None:
    """First block of the first file that begins with a name, in any case."""
    if not name:
        return next((block for _, block, flags in entries(directory) if not flags & DIRECTORY), None)
    return next((block for own, block, flags in entries(directory) if not flags & DIRECTORY and own[: len(name)].upper() == name.upper()), None)


def named_program(start: bytes, prefix: bytes) -> bytes | None:
    """The rest of the first line after a prefix, without slashes before it."""
    if not start.startswith(prefix):
        return None
    return re.split(rb"[\r\n\0]", start[len(prefix) :].lstrip(b"\\/"), maxsplit=1)[0][:255]


def is_first_system(image: bytes) -> bool:
    descriptor = content(image, DESCRIPTOR)
    if descriptor is None:
        return False
    block = int.from_bytes(descriptor[ROOT + 2 : ROOT + 6], "little", signed=True)
    parts = content(image, block), content(image, block + 1)
    if None in parts:
        return False
    root = b"".join(parts)
    at = find(root, START)
    if at is None:
        return find(root, DEFAULT) is not None
    start = content(image, at)
    if start is None:
        return False
    for text in (start if start.startswith(b"BOOT = " + DEVICE) else b"", start[start.find(DEVICE) :] if DEVICE in start else b""):
        program = named_program(text, b"BOOT = " + DEVICE if text.startswith(b"BOOT") else DEVICE)
        if program is not None and find(root, program) is not None:
            return True
    return False


def is_other_system(image: bytes) -> bool:
    return image[OTHER_AT : OTHER_AT + len(OTHER)] == OTHER and OTHER_AT < len(image) - len(OTHER)


def sheet_tracks(sheets: DataFrame) -> DataFrame:
    """``path, track, image, mode`` of the first two tracks of cue sheets (path, text), with the file that each is in."""
    parts = F.split("text", r"(?m)^\s*TRACK\s+")  # what stands before a track, and each track's lines
    mode = lambda n: F.regexp_extract(F.try_element_at(parts, F.lit(n + 1)), r"^\d+\s+(\S+)", 1)
    before = lambda n: F.array_join(F.slice(parts, 1, n), "\n")
    files = lambda n: F.regexp_extract_all(before(n), F.lit(r'(?m)^\s*FILE\s+"?([^"\r\n]+?)"?\s+\S+\s*$'), F.lit(1))
    tracks = F.array(*[F.struct(F.lit(n).alias("track"), F.try_element_at(files(n), F.lit(-1)).alias("image"), F.upper(mode(n)).alias("mode")) for n in (1, 2)])
    return sheets.select("path", F.explode(tracks).alias("t")).select("path", "t.*").where("image IS NOT NULL AND mode <> ''")


def games(sheets: DataFrame, images: DataFrame) -> DataFrame:
    """``path, image, system`` of the cue sheets (path, text) whose image (path, content) is a game: "psx" or "tg".

    The image is looked for under the name that the sheet gives, then beside
    the sheet.  A first track of raw data frames may be of the one system, and
    if it isn't, a second track of data of the other.
    """
    kind = F.when((F.col("track") == 1) & F.col("mode").isin(*RAW_MODES), "psx").when((F.col("track") == 2) & F.col("mode").startswith("MODE1"), "tg")
    beside = F.concat(parent(F.col("path")), F.lit("/"), base_name(F.col("image")))
    wanted = sheet_tracks(sheets).withColumn("kind", kind).where("kind IS NOT NULL")
    places = wanted.select("path", "kind", F.posexplode(F.array("image", beside)).alias("rank", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            told = [(place, is_first_system(image or b""), is_other_system(image or b"")) for place, image in rows]
            columns = zip(*told, strict=True) if told else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["place", "psx", "tg"])

    # Each image is judged once, where it is read; only the verdicts are joined.
    verdicts = map_batches(images.select("path", "content"), run, "place string, psx boolean, tg boolean")
    ok = F.when(F.col("kind") == "psx", F.col("psx")).otherwise(F.col("tg"))
    there = places.join(verdicts, "place").groupBy("path", "kind").agg(F.min(F.struct("rank", (~ok).alias("other"), F.col("place").alias("image"))).alias("v"))
    found = there.where("NOT v.other").select("path", "v.image", F.col("kind").alias("system"))
    return found.groupBy("path").agg(F.min_by("image", "system").alias("image"), F.min("system").alias("system"))
