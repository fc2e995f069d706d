"""String functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _decomposed() -> tuple[str, str]:
    """Small letters with marks, what they become, and at the end the marks themselves, which go."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    known = [(c, d[0]) for c, d in pairs if len(d) > 1 and c == c.lower() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in known) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in known)


MARKED, PLAIN = _decomposed()


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def coalesce_strip(*columns: Column) -> Column:
    """The first that isn't blank, without outer blanks."""
    return F.coalesce(*[F.when(~blank(c), F.trim(c)) for c in columns])


def merge(delimiter: str, *columns: Column) -> Column:
    """All that aren't null, joined; null if all are."""
    return F.when(F.coalesce(*columns).isNotNull(), F.concat_ws(delimiter, *columns))


def unaccent(c: Column) -> Column:
    """In small letters, without the marks that letters can be decomposed into."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def plain(term: str) -> str:
    """The same for a search term."""
    return "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))


def normalize(c: Column, max_words: int) -> Column:
    """Letters only, other runs become one blank; max_words + 1 words at most."""
    words = F.split(F.trim(F.regexp_replace(c, r"[^\p{L}]+", " ")), " ")
    return F.array_join(F.slice(words, 1, max_words + 1), " ")


def truncate(c: Column, longest: int) -> Column:
    """Longer strings end in a mark and have ``longest`` characters."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("[…]"))).otherwise(c)


def ellipsize(c: Column, longest: int, at_end: bool = True) -> Column:
    short = F.concat(F.substring(c, 1, longest - 1), F.lit("…")) if at_end else F.concat(F.lit("…"), F.right(c, F.lit(longest - 1)))
    return F.when(F.length(c) > longest, short).otherwise(c)


def hex_pairs(c: Column, delimiter: str = ":") -> Column:
    """Bytes as pairs of capital digits with a delimiter between them."""
    return F.rtrim(F.regexp_replace(F.hex(c), "(..)", "$1" + delimiter), F.lit(delimiter))


def keywords(c: Column) -> Column:
    """Keywords of a quoted list: from after the first quote, without the last one, cut at , and ;.

    One leading blank of a keyword goes, or else one trailing blank; repeats go.
    """
    inner = F.regexp_replace(F.regexp_replace(c, '^[^"]*"', ""), '"$', "")
    parts = F.split(inner, "[,;]")
    return F.array_distinct(F.filter(F.transform(parts, lambda k: F.when(k.startswith(" "), F.substring(k, 2, 1 << 30)).otherwise(F.regexp_replace(k, " $", ""))), lambda k: k != ""))


def seconds_text(c: Column) -> Column:
    """1d 02h 03m 04s without leading parts that are 0; nothing: less than one second."""
    d, h, m, s = F.floor(c / 86400), F.floor(c / 3600) % 24, F.floor(c / 60) % 60, F.floor(c) % 60
    part = lambda v, text: F.when(v > 0, text)
    text = F.concat_ws(" ", part(d, F.concat(d.cast("string"), F.lit("d"))), part(h, F.format_string("%02dh", h)), part(m, F.format_string("%02dm", m)), part(s, F.format_string("%02ds", s)))
    return F.when(text == "", F.lit("less than one second")).otherwise(text)


def literal(c: Column) -> Column:
    """Escaped for a quoted literal."""
    pairs = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"'))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def shorten(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix:name of an IRI whose part up to # is known."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    known = F.element_at(table, F.concat(F.substring_index(iri, "#", 1), F.lit("#")))
    return F.when(known.isNotNull(), F.concat(known, F.lit(":"), F.substring_index(iri, "#", -1))).otherwise(iri)


def stem(c: Column) -> Column:
    """Up to the last dot."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def same_stem(a: Column, b: Column) -> Column:
    return F.lower(stem(a)) == F.lower(stem(b))


def extension_changed(a: Column, b: Column) -> Column:
    last = lambda c: F.when(c.contains("."), F.substring_index(c, ".", -1))
    return ~last(a).eqNullSafe(last(b))


def title_of(file_name: Column) -> Column:
    """A file name as a title: no extension (a dot file keeps its name), blanks for _."""
    return F.translate(F.when(file_name.rlike(r"^\.[^.]*$"), file_name).otherwise(stem(file_name)), "_", " ")


def tokens(c: Column, longest: int = 200, stop: list[str] | None = None) -> Column:
    """Search words: letters and digits without marks, none longer than ``longest``."""
    words = F.filter(F.split(unaccent(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.length(w) <= longest))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def snippet(c: Column, terms: list[str], before: int = 20, length: int = 60) -> Column:
    """The text around the first word that is one of the terms, on one line."""
    any_term = "|".join(re.escape(plain(t)) for t in terms)
    at = F.regexp_instr(unaccent(c), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{any_term})(?![\p{{L}}\p{{N}}])"))
    return F.translate(F.substring(c, F.greatest(at - before, F.lit(1)), F.lit(length)), "\r\n", "  ")


def urn_escape(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def octal_triplets(c: Column) -> Column:
    r"""Bytes written as ``\303\230`` put back; what isn't UTF-8 then becomes U+FFFD."""
    digit = lambda t, k: F.substring(t, k, 1).try_cast("int")
    byte = lambda t: F.lpad(F.hex(digit(t, 2) * 64 + digit(t, 3) * 8 + digit(t, 4)), 2, "0")
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\[0-3][0-7][0-7]|[^\\]+|\\"), F.lit(0))
    hexed = F.transform(parts, lambda t: F.when(t.rlike(r"^\\[0-3]"), byte(t)).otherwise(F.hex(t)))
    return F.make_valid_utf8(F.unhex(F.array_join(hexed, "")).cast("string"))


def index_in(c: Column, values: list[str]) -> Column:
    """Place of a string in a list, in any case, from 0 on; -1 if it isn't there."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v.lower()) for v in values]), F.lower(c)) - 1, F.lit(-1)).cast("long")
