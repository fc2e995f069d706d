"""Configured index roots: which one holds a path, filters, reconciliation of mounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.paths import ancestors, base_name, glob_regex, hidden, is_under, parent
from sextant.functions.tables import few


def longest_root(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """``path, root``: the deepest root that is the path or one of its folders (by equality of ancestors)."""
    up = paths.select(path, F.explode(ancestors(F.col(path))).alias(root))
    return up.join(roots.select(root), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def reparent(roots: DataFrame, root: str = "root") -> DataFrame:
    """``root, parent``: the deepest other root above each root, null for the topmost."""
    up = roots.select(root, F.explode(ancestors(parent(F.col(root)))).alias("parent"))
    held = up.join(roots.select(F.col(root).alias("parent")), "parent").groupBy(root).agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return roots.select(root).join(held, root, "left")


def dedupe_roots(roots: DataFrame, root: str = "root") -> DataFrame:
    """Without roots below other roots."""
    return reparent(roots.distinct(), root).where("parent IS NULL").select(root)


def filtered(name: Column, globs: list[str], accept_by_default: bool = True) -> Column:
    """Whether a name is filtered out: it matches under ACCEPT, it doesn't under DENY."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | name.rlike(glob_regex(g))
    return hit if accept_by_default else ~hit


def path_filtered(path: Column, pattern: str) -> Column:
    """An absolute pattern: the path itself or all below it."""
    return (path == pattern) | is_under(path, F.lit(pattern))


def indexable(paths: DataFrame, roots: DataFrame, globs: list[str], accept_by_default: bool = True) -> DataFrame:
    """``path, root, indexable``; roots: root, recursive, ignored.

    A root must hold the path and not be ignored; the path must be the root, in
    a recursive root or directly below it, and neither filtered nor hidden.
    """
    held = longest_root(paths, roots)
    with_root = paths.select("path").join(held, "path", "left").join(roots, "root", "left")
    name = base_name(F.col("path"))
    inside = (F.col("path") == F.col("root")) | F.col("recursive") | (parent(F.col("path")) == F.col("root"))
    fine = F.col("root").isNotNull() & ~F.col("ignored") & inside & ~filtered(name, globs, accept_by_default) & ~hidden(name)
    return with_root.select("path", "root", F.coalesce(fine, F.lit(False)).alias("indexable"))


def poisoned(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files of folders that hold no file with one of these names (whole folders go)."""
    bad = files.where(filtered(base_name(F.col("path")), globs)).select(parent(F.col("path")).alias("folder")).distinct()
    return files.withColumn("folder", parent(F.col("path"))).join(bad, "folder", "left_anti").select(files.columns)


def reconcile_mounts(stored: DataFrame, mounted: DataFrame) -> DataFrame:
    """``urn, action``: of volumes (urn, available) in the store and mounted ones (urn)."""
    both = stored.select("urn", F.col("available"), F.lit(True).alias("known")).join(mounted.select("urn", F.lit(True).alias("there")), "urn", "full_outer")
    action = F.when(F.col("known").isNull(), "ADD").when(F.col("there").isNull() & F.col("available"), "UNMOUNT").when(F.col("there") & ~F.col("available"), "MOUNT").otherwise("NONE")
    return both.select("urn", action.alias("action"))


def dispatch(mimes: DataFrame, rules: DataFrame) -> DataFrame:
    """``mime, module``: of the first rule, in file-name order, whose globs allow the mime and whose blocks don't.

    rules: rule_order, module, allow_regex, block_regex (null: none).  Only the
    different mimes meet the rules, a table of a few dozen rows.
    """
    allowed = F.expr("mime RLIKE allow_regex AND NOT coalesce(mime RLIKE block_regex, false)")
    return mimes.select("mime").distinct().join(few(rules), allowed).groupBy("mime").agg(F.min_by("module", "rule_order").alias("module"))


def to_visit(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, path`` of the folders that a crawl lists; folders: path, mount; roots: root, recursive, ignored.

    The root itself, and the folders of a recursive one down to the mount
    points in it; what lies below another root belongs to that root.
    """
    held = longest_root(folders, roots).join(roots.where("NOT ignored").select("root", "recursive"), "root")
    mounts = folders.where("mount").select(F.col("path").alias("up"))
    up = held.select("root", "path", F.explode(ancestors(F.col("path"))).alias("up")).where(is_under(F.col("up"), F.col("root")))
    barred = up.join(mounts, "up", "left_semi").select("path").distinct()
    return held.where((F.col("path") == F.col("root")) | F.col("recursive")).join(barred, "path", "left_anti").select("root", "path")


def without_ignored(stored: DataFrame, roots: DataFrame) -> DataFrame:
    """``stored`` (path, ...) without all that lies in ignored roots; preserved ones stay as they are (root, ignored, preserved)."""
    gone = roots.where("ignored AND NOT preserved").select(F.col("root").alias("_up"))
    below = stored.select("path", F.explode(ancestors(F.col("path"))).alias("_up")).join(gone, "_up", "left_semi").select("path").distinct()
    return stored.join(below, "path", "left_anti").select(stored.columns)
