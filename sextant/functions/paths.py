"""Paths and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """* and ? only; everything else is meant literally."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def glob_column(glob: Column) -> Column:
    """The same for globs that are data."""
    quoted = F.regexp_replace(glob, r"([.\\+^$()\[\]{}|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def parent(c: Column) -> Column:
    return F.regexp_replace(c, "/[^/]*$", "")


def is_under(path: Column, folder: Column) -> Column:
    return F.startswith(path, F.concat(folder, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path itself and all its folders, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))
