"""Disk against store, and mutations of the store as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.paths import ancestors, is_under
from sextant.functions.tables import one_each


def diff(disk: DataFrame, store: DataFrame) -> DataFrame:
    """``uri, state``: CREATE, UPDATE or DELETE of what differs.

    disk: uri, mtime (s), hash (of the mime's extractor); store: uri, mtime, mime, hash.
    """
    both = disk.select("uri", F.col("mtime").alias("disk_mtime"), F.col("hash").alias("disk_hash"), F.lit(True).alias("on_disk")).join(
        store.select("uri", F.col("mtime").alias("store_mtime"), "mime", F.col("hash").alias("store_hash"), F.lit(True).alias("in_store")), "uri", "full_outer"
    )
    state = (
        F.when(F.col("in_store").isNull(), "CREATE")
        .when(F.col("on_disk").isNull(), "DELETE")
        .when(F.col("disk_mtime") != F.col("store_mtime"), "UPDATE")
        .when(F.col("mime").isNotNull() & ~F.col("disk_hash").eqNullSafe(F.col("store_hash")), "UPDATE")
    )
    return both.select("uri", state.alias("state")).where("state IS NOT NULL")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those with the same keys; of several with one key one counts."""
    changes = one_each(changes, keys)
    return table.join(changes.select(keys), keys, "left_anti").unionByName(changes)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(keys), keys, "left_anti").select(table.columns))


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(keys).distinct(), keys, "left_anti").select(table.columns)


def delete_under(table: DataFrame, uri: str, key: str = "uri", itself: bool = False) -> DataFrame:
    """All below a folder, and the folder itself if asked for."""
    hit = is_under(F.col(key), F.lit(uri))
    return table.where(~(hit | (F.col(key) == uri) if itself else hit))


def move(table: DataFrame, old: str, new: str, key: str = "uri", recursive: bool = True) -> DataFrame:
    under = is_under(F.col(key), F.lit(old))
    moved = F.when(F.col(key) == old, F.lit(new))
    if recursive:
        moved = moved.when(under, F.concat(F.lit(new), F.substring(F.col(key), len(old) + 1, 1 << 30)))
    return table.withColumn(key, moved.otherwise(F.col(key)))


def invalidate(elements: DataFrame, uris: DataFrame, key: str = "uri") -> DataFrame:
    """Forgets the extractor's hash of some files, so that they are extracted again."""
    marked = elements.join(uris.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    return marked.withColumn("hash", F.when(F.col("_hit").isNull(), F.col("hash"))).select(elements.columns)


def set_attributes(files: DataFrame, changes: DataFrame, columns: list[str], key: str = "uri") -> DataFrame:
    """New values of some columns, where given; of several changes of one file one counts."""
    new = one_each(changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), [key])
    both = files.join(new, key, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in files.columns])


def mark_volumes(volumes: DataFrame, urns: list[str], available: bool, at: Column) -> DataFrame:
    hit = F.col("urn").isin(urns)
    stamp = F.when(hit, F.lit(None) if available else at).otherwise(F.col("unmount_date"))
    return volumes.withColumns({"available": F.when(hit, F.lit(available)).otherwise(F.col("available")), "unmount_date": stamp})


def delete_of_volumes(files: DataFrame, volumes: DataFrame, which: Column) -> DataFrame:
    """Without the files on volumes that fit a condition (removable, unmounted before a date, ...)."""
    gone = volumes.where(which).select(F.col("urn").alias("data_source"))
    return files.join(gone, "data_source", "left_anti").select(files.columns)


def work_list(elements: DataFrame, hashed: DataFrame, ranks: dict[str, int], after: tuple[int, str] | None = None, batch: int = 200) -> DataFrame:
    """Elements without an extractor's hash, first graphs first; pages by key, not by offset."""
    rank = F.coalesce(*[F.when(F.col("graph") == g, r) for g, r in ranks.items()], F.lit(99))
    left = elements.join(hashed.select("ie"), "ie", "left_anti").select(rank.alias("rank"), "ie", "url")
    if after:
        left = left.where((F.col("rank") > after[0]) | ((F.col("rank") == after[0]) & (F.col("ie") > after[1])))
    return left.orderBy("rank", "ie").limit(batch)


def move_all(files: DataFrame, moves: DataFrame, key: str = "uri") -> DataFrame:
    """Many moves (old, new, deep) at once, each with what is below it.

    A file at a destination is deleted first, unless it moves itself.  What is
    below a folder that isn't ``deep``, as its new place is indexed without
    what is below, is deleted.  Of several moved folders above a file the
    deepest counts.
    """
    up = files.select(key, F.explode(ancestors(F.col(key))).alias("old")).join(moves, "old")
    nearest = up.groupBy(key).agg(F.max_by(F.struct("old", "new", "deep"), F.length("old")).alias("m"))
    both = files.join(nearest, key, "left")
    stays = F.col("m").isNull() | (F.col(key) == F.col("m.old")) | F.col("m.deep")
    target = F.when(F.col("m").isNull(), F.col(key)).otherwise(F.concat("m.new", F.expr(f"substring({key}, length(m.old) + 1)")))
    there = both.where(F.col("m").isNull()).join(moves.select(F.col("new").alias(key)).distinct(), key, "left_semi").select(key)
    left = both.join(there, key, "left_anti").where(stays)
    return left.select(*[target.alias(key) if c == key else F.col(c) for c in files.columns])
