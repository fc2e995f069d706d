"""Exact deduplication by a tree merge of sorted digest runs.

Each scan partition is a leaf run: its rows shrink to (digest, byte count,
check hash) keys sorted by digest, one entry per key with the best identifier
and the number of rows.  Runs are merged in binomial rounds: in round r the
runs whose numbers agree above the lowest ``bits`` * r bits meet, ``2**bits``
at a time, and every merged entry keeps the best identifier seen so far.  The
work of a round is dealt out by (run, digest), so even the last merge uses
every task.  The winners then travel down the same tree, so that a row only
ever meets the entry of its own run: however many copies a text has, no join
key holds more rows than one scan partition.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import load, stage, text_hash, without_unkept

KEY = ["digest", "n_bytes", "check"]


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with its leaf run, key and a row number that breaks ties."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        text_hash(body).alias("check"),
    )


def _merge(runs: DataFrame, run: Column, best: Column, size: Column) -> DataFrame:
    merged = runs.groupBy(run.alias("run"), *KEY).agg(F.max(best).alias("best"), F.sum(size).alias("size"))
    return merged.sortWithinPartitions("run", *KEY)


def tree_merge(rows: DataFrame, bits: int, keep_largest: bool) -> DataFrame:
    """Adds ``best`` (struct of the winner's id and row) and ``size`` to each row of ``rows``."""
    sign = 1 if keep_largest else -1
    # A null id loses to every other id; of equal ids the earliest row wins.
    order = F.struct(
        F.col("id").isNotNull().alias("has_id"),
        (F.col("id") * sign).alias("rank"),
        (-F.col("row")).alias("first"),
        F.col("id").alias("id"),
    )
    runs = rows.agg(F.max("run")).first()[0]
    levels = [stage(_merge(rows, F.col("run"), order, F.lit(1)), "runs")]
    while runs:
        runs >>= bits
        levels.append(stage(_merge(levels[-1], F.shiftright("run", bits), F.col("best"), F.col("size")), "runs"))
    winners = levels.pop()
    while levels:
        below = levels.pop().select(F.col("run").alias("below"), F.shiftright("run", bits).alias("run"), *KEY)
        winners = below.join(winners, ["run", *KEY]).select(F.col("below").alias("run"), *KEY, "best", "size")
    return rows.join(winners, ["run", *KEY])


def _groups(docs: DataFrame, id_col: str, text_col: str, keep: str, bits: int) -> DataFrame:
    """exact_groups() with the hash of each text."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep!r}")
    rows = stage(digest_runs(docs.select(id_col, text_col), id_col, text_col), "digests")
    if rows.isEmpty():
        joined = rows.withColumns({"best": F.struct(F.col("id"), (-F.col("row")).alias("first")), "size": F.lit(0).cast("long")})
    else:
        joined = tree_merge(rows, bits, keep == "largest")
    return joined.select(
        F.col("check").alias("text_hash"),
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("best.first") == -F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    bits: int = 4,
) -> DataFrame:
    """Groups of documents with identical texts, one output row per input row.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.  A null text
    counts as empty, so all null and empty texts are one group.  Of rows that
    repeat the winning id exactly one is kept; a null id wins only where all
    ids of the group are null (then ``keep_id`` is null).  An empty table
    gives an empty result.  Other columns, whatever their names, are ignored.
    ``keep`` is "largest" or "smallest" (by id).  ``2**bits`` runs meet in
    each merge.
    """
    return _groups(docs, id_col, text_col, keep, bits).drop("text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    return without_unkept(docs, id_col, text_col, _groups(docs, id_col, text_col, keep, 4))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"), keep="largest")


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents"""
}
