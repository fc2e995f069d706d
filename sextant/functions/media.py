"""Functions of media metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the metering modes 0 to 6, EXIF flash values without light, beginnings of region types.
METERING = ("other", "average", "center-weighted-average", "spot", "multispot", "pattern", "partial")
DARK = (0x00, 0x05, 0x08, 0x10, 0x18, 0x58)
REGIONS = ("face", "pet", "focus", "barcode")
# Names of the EXIF orientations 1 to 8.
ORIENTATIONS = ("top", "top-mirror", "bottom-mirror", "bottom", "left-mirror", "right", "right-mirror", "left")


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees in single precision; south and west are negative."""
    value = (degrees + minutes / 60 + seconds / 3600).cast("float").cast("double")
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def rational(c: Column) -> Column:
    """a/b as a number; null if b is 0."""
    a, b = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(~c.contains("/"), c.try_cast("double")).when(b != 0, a / b)


def exposure(c: Column) -> Column:
    """Seconds: one over what follows a slash, else as written."""
    below = F.regexp_extract(c, r"/\s*([0-9.]+)", 1).try_cast("double")
    return F.when(below > 0, F.lit(1.0) / below).otherwise(c.try_cast("double"))


def fnumber(c: Column) -> Column:
    """Without a leading F or f/."""
    return F.when(c != "", F.trim(F.regexp_replace(c, "^(F|f/)", "")))


def altitude(value: Column, ref: Column) -> Column:
    """Metres in single precision; ref 1: below sea level."""
    metres = value.cast("float").cast("double")
    return F.when(ref == 1, -metres).otherwise(metres)


def gps_text(c: Column) -> Column:
    """Decimal degrees of deg,min.fraction and a direction; null for other texts."""
    part = lambda k: F.regexp_extract(c, r"([0-9]+),([0-9]+\.[0-9]+)([A-Z])", k)
    value = part(1).try_cast("double") + part(2).try_cast("double") / 60
    return F.when(part(3).isin("S", "W"), -value).otherwise(value)


def metering(n: Column) -> Column:
    table = F.array(*[F.lit(f"nmm:metering-mode-{m}") for m in METERING])
    return F.when(n.isNotNull(), F.coalesce(F.get(table, n.cast("int")), F.lit("nmm:metering-mode-other")))


def flash(n: Column, by_bit: bool = False) -> Column:
    """EXIF values by their list, XMP values by their lowest bit."""
    off = n.bitwiseAND(F.lit(1)) == 0 if by_bit else n.isin(*DARK)
    return F.when(off, "nmm:flash-off").when(~off, "nmm:flash-on")


def white_balance(n: Column) -> Column:
    return F.when(n == 0, "nmm:white-balance-auto").when(n != 0, "nmm:white-balance-manual")


def region_type(c: Column) -> Column:
    """By its beginning, in any case."""
    kind = F.lower(c)
    known = F.coalesce(*[F.when(kind.startswith(r), F.lit(f"nfo:roi-content-{r}")) for r in REGIONS], F.lit("nfo:roi-content-undefined"))
    return F.when(c.isNull(), "nfo:region-content-undefined").otherwise(known)


def without(c: Column, prefix: str = "", suffix: str = "") -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + prefix, ""), suffix + "$", "")


def orientation(n: Column) -> Column:
    table = F.array(*[F.lit(f"nfo:orientation-{o}") for o in ORIENTATIONS])
    return F.when(n.between(1, 8), F.element_at(table, n.cast("int"))).otherwise(F.lit("nfo:orientation-top"))


def frames_to_seconds(frames: Column) -> Column:
    """Of an audio disc: 75 frames a second."""
    return frames / 75.0


def resolution(value: Column, unit: Column) -> Column:
    """Dots per inch of a value per inch (2) or centimetre (3)."""
    return F.when(unit == 3, value * 2.54).otherwise(value)


def synchsafe(b: Column) -> Column:
    """Four bytes of seven bits each."""
    byte = lambda k: F.conv(F.hex(F.substring(b, k, 1)), 16, 10).cast("long")
    return byte(1) * 2097152 + byte(2) * 16384 + byte(3) * 128 + byte(4)


def region_index(path: Column) -> Column:
    """Which region of its list a property path belongs to, from 1 on; -1 for none."""
    return F.coalesce(F.regexp_extract(path, r"RegionList\[(\d+)\]", 1).try_cast("int"), F.lit(-1))


# Media server profiles of JPEG images by greatest width and height.
JPEG_PROFILES = (("JPEG_SM", 640, 480), ("JPEG_MED", 1024, 768), ("JPEG_LRG", 4096, 4096))


def image_profile(mime: Column, width: Column, height: Column, depth: Column) -> Column:
    """Media server profile of a JPEG or PNG image; null beyond all of them."""
    within = lambda w, h: (width <= w) & (height <= h)
    jpeg = F.coalesce(*[F.when(within(w, h), F.lit(name)) for name, w, h in JPEG_PROFILES])
    icon = lambda size: (width == size) & (height == size)
    png = F.when(icon(120), "PNG_LRG_ICO").when(icon(48), "PNG_SM_ICO").when(within(160, 160), "PNG_TN").when((depth <= 32) & within(4096, 4096), "PNG_LRG")
    return F.when(mime == "image/jpeg", jpeg).when(mime == "image/png", png)
