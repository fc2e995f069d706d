"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item is a weighted set of word shingles (a shingle weighs as
often as it occurs) with a 64-bit SimHash.  Documents are searched with
windows of the items' own lengths.  A window can only reach the similarity
``threshold`` if the document holds at least that share of an item's shingles,
so windows are cut only around such places; nothing that could match is lost.
Each window's SimHash is split into eight blocks of eight bits.  Two
fingerprints within ``radius`` bits differ in at most ``radius // 8`` bits of
some block, so every item is indexed under all block values within that
distance and an equality join finds every fingerprint within the radius.
The weighted similarity (sum of minima over sum of maxima) of what is found is
then computed exactly.

What the radius guarantees: a bit of the fingerprints differs with the angle
between the weight vectors over pi.  A window of an item's length at the
similarity 0.8 has 8/9 of the weight in common, which is an angle of 0.475 and
a chance of 0.151 a bit for shingles without repeats; of 64 bits more than 23
differ with about 1e-5, and more rarely for closer windows.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import load, small, split_by, stage, text_hash, without_texts

WORDS = 5
BLOCKS, BITS = 8, 8
#: A block's eight bits stand seven apart in a long, so that up to GROUP of them can be added without a carry.
LANE, GROUP = 7, 60
#: Parts over which the shingles of one hash are dealt where the items' shingles aren't broadcast.
SALTS = 16
ONES = sum(1 << LANE * j for j in range(BITS))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashed: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; ``hashed``: the words' hashes."""
    last = F.size(hashed) - k
    run = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))
    return F.when(last >= 0, run).otherwise(F.array().cast("array<long>"))


def lanes(hashes: Column) -> Column:
    """Of each hash, its blocks as longs with the bits a lane apart."""
    # Four copies of half a byte, six bits apart: bit j of copy j is at lane j.
    copies, pick = F.lit(sum(1 << 6 * j for j in range(4))), F.lit(sum(1 << LANE * j for j in range(4)))

    def half(h: Column, shift: int) -> Column:
        return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(15)) * copies).bitwiseAND(pick)

    def block(h: Column, b: int) -> Column:
        return half(h, BITS * b).bitwiseOR(F.shiftleft(half(h, BITS * b + 4), 4 * LANE)).alias(f"b{b}")

    return F.transform(hashes, lambda h: F.struct(*[block(h, b) for b in range(BLOCKS)]))


def _majorities(votes: Column) -> Column:
    """One vote for each GROUP votes: each bit as most of them have it."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"b{b}") for b in range(BLOCKS)])

    def most(some: Column) -> Column:
        # The top bit of a lane is set where its count is more than half.
        lift = (F.lit(63) - F.floor(F.size(some) / 2).cast("long")) * F.lit(ONES)
        return F.aggregate(
            some,
            zero,
            lambda a, v: F.struct(*[(a[f"b{b}"] + v[f"b{b}"]).alias(f"b{b}") for b in range(BLOCKS)]),
            lambda a: F.struct(*[F.shiftrightunsigned(a[f"b{b}"] + lift, LANE - 1).bitwiseAND(F.lit(ONES)).alias(f"b{b}") for b in range(BLOCKS)]),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(votes) - 1) / GROUP).cast("int")), lambda g: most(F.slice(votes, g * GROUP + 1, GROUP)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def simhash_blocks(votes: Column, longest: int) -> Column:
    """Array of the eight blocks of a SimHash; ``votes``: lanes() of 1 to ``longest`` shingles.

    Where more than GROUP shingles can occur, every GROUP shingles vote as one, and so on.
    """
    while longest > 1:
        votes, longest = _let(votes, _majorities), -(-longest // GROUP)
    return _let(F.get(votes, 0), lambda v: F.array(*[v[f"b{b}"] for b in range(BLOCKS)]))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger ones."""
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v)))
    return both / (F.size(a) + F.size(b) - both)


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, n, k, hashes``: items that have a word; short items are one shingle."""
    split = benchmark.select(F.col(id_col).alias("item_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("hashed"))
    sized = split.where(F.size("hashed") > 0).withColumns({"n": F.size("hashed"), "k": F.least(F.size("hashed"), F.lit(WORDS))})
    hashes = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("hashed"), k)) for k in range(1, WORDS + 1)])
    return sized.select("item_id", "n", "k", hashes.alias("hashes"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.8,
    radius: int = 23,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words``: every item found in every document.

    The most similar window counts, of equally similar ones the first; it ends
    early where the document does.  Words are runs of letters and digits in
    lower case.  Null and empty texts and items without a word match nothing;
    repeated rows of a document or an item are reported once; empty tables give
    an empty result; other columns are ignored.
    """
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, threshold, radius, broadcast_rows)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), "n_words"))
    found = found.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start_word"), "best.n_words")


def _runs(hashed: Column, lengths: list[int]) -> Column:
    """Structs (k, hashes): the shingles of each length."""
    return F.array(*[F.struct(F.lit(k).alias("k"), shingles(hashed, k).alias("hashes")) for k in lengths])


def _hits(docs: DataFrame, items: DataFrame, lengths: list[int], broadcast_rows: int) -> DataFrame:
    """``doc_id, text_hash, k, at, n``: where documents have a shingle of an item of n words."""
    hashed = docs.select("text_hash", "doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashed"))
    runs = hashed.select("text_hash", "doc_id", F.explode(_runs(F.col("hashed"), lengths)).alias("run"))
    # The outer form of explode keeps Spark from deriving filters that would compute the arrays again.
    found = runs.select("doc_id", "text_hash", F.col("run.k").alias("k"), F.posexplode_outer("run.hashes").alias("at", "h"))
    known = stage(items.select("k", "n", F.explode("hashes").alias("h")).distinct(), "item_shingles")
    if known.count() <= broadcast_rows:
        return found.join(F.broadcast(known), ["k", "h"]).drop("h")  # bounded: rows of three numbers
    # Most shingles are of no item; the others of one hash are dealt over SALTS parts, with the items' in each.
    some = split_by(found, known, ["h"])[0].withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.lit(SALTS)))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return some.join(known, ["k", "h", "salt"]).drop("h", "salt")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, radius: int = 23, broadcast_rows: int = 500_000) -> DataFrame:
    """find_leaks() for each text of an id, with its hash."""
    items = stage(items_of(benchmark, item_col, item_text_col).withColumn("item", F.xxhash64("hashes")).dropDuplicates(["item_id", "hashes"]), "items")
    longest = max(GROUP, items.agg(F.max(F.size("hashes"))).first()[0] or 0)
    lengths = [r.k for r in items.select("k").distinct().orderBy("k").collect()] or [WORDS]  # at most WORDS rows
    docs = docs.select(text_hash(F.col(text_col)).alias("text_hash"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    reach = F.col("n") - F.col("k")
    places = _hits(docs, items, lengths, broadcast_rows).groupBy("doc_id", "text_hash", "k", "n").agg(F.collect_set("at").alias("at"))
    # An item has n - k + 1 shingles; a window as similar as asked for has the threshold's share of them.
    places = stage(places.where(F.size("at") >= F.ceil(F.lit(threshold) * (reach + 1) - 1e-9)), "places")

    # Only texts with places are cut into shingles again, once for each length.
    there = places.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "k").agg(F.collect_list(F.struct("n", "at")).alias("places"))
    some = split_by(docs, places.select("doc_id", "text_hash"), ["doc_id", "text_hash"])[0]
    some = some.join(there, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    some = some.select("doc_id", "text_hash", "k", "places", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashed"))
    hashes = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("hashed"), k)) for k in lengths])
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.lit(0), p - reach), p))))
    windows = (
        some.select("doc_id", "text_hash", "k", "places", hashes.alias("hashes"))
        .withColumn("votes", lanes(F.col("hashes")))
        .select("doc_id", "text_hash", "k", "hashes", "votes", F.inline_outer("places"))
        .select("doc_id", "text_hash", "k", "n", "hashes", "votes", F.explode_outer(starts).alias("start"))
        .select("doc_id", "text_hash", "k", "n", "start", F.slice("hashes", F.col("start") + 1, reach + 1).alias("window"), F.slice("votes", F.col("start") + 1, reach + 1).alias("votes"))
        .select("doc_id", "text_hash", "k", "n", "start", "window", simhash_blocks(F.col("votes"), longest).alias("blocks"))
    )
    # Every block value of an item within radius // BLOCKS bits.
    flips = [sum(1 << LANE * b for b in bits) for d in range(radius // BLOCKS + 1) for bits in combinations(range(BITS), d)]
    marked = stage(items.withColumn("votes", lanes(F.col("hashes"))).withColumn("item_blocks", simhash_blocks(F.col("votes"), longest)).drop("votes"), "marked_items")
    probes = (
        marked.select("item_id", "item", "k", "n", "item_blocks", F.posexplode("item_blocks").alias("block", "value"))
        .withColumn("flip", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])))
        .select("item_id", "item", "k", "n", "item_blocks", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    )
    indexed = windows.select("*", F.posexplode_outer("blocks").alias("block", "value"))
    bits = F.aggregate(F.zip_with("blocks", "item_blocks", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    near = indexed.join(small(probes, broadcast_rows), ["k", "n", "block", "value"])
    # Of the blocks that bring a pair together, only the first is followed.
    first = F.array_position(
        F.zip_with("blocks", "item_blocks", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius // BLOCKS), F.lit(True)
    )
    near = near.where((first == F.col("block") + 1) & (bits <= radius)).select("doc_id", "text_hash", "item_id", "item", "n", "start", "window")
    near = near.join(marked.select(F.col("item_id").alias("_id"), F.col("item").alias("_item"), F.col("hashes").alias("known")), F.col("item_id").eqNullSafe(F.col("_id")) & (F.col("item") == F.col("_item")))
    near = near.withColumn("similarity", weighted_similarity(F.col("window"), F.col("known")))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), F.col("n")))
    found = near.where(F.col("similarity") >= threshold).groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "text_hash", "item_id", "best.similarity", (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any item; all columns unchanged."""
    return without_texts(docs, id_col, text_col, _leaks(docs, benchmark, id_col, text_col).select("doc_id", "text_hash"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE = {
    "op10_decontamination": r"""
        WITH doc_words AS (
            SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents
        ), item_words AS (
            SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark
        ), items AS (
            SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS k FROM item_words WHERE len(ws) > 0
        ), item_shingles AS (
            SELECT item_id, n, k, array_to_string(ws[i:i + k - 1], ' ') AS s, count(*) AS c
            FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM items) GROUP BY ALL
        ), doc_shingles AS (
            SELECT doc_id, k, i - 1 AS pos, array_to_string(ws[i:i + k - 1], ' ') AS s
            FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i
                  FROM doc_words, (SELECT DISTINCT k FROM items))
        ), hits AS (
            SELECT doc_id, item_id, n, k, pos FROM doc_shingles JOIN item_shingles USING (k, s)
        ), windows AS (
            SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(0, pos - (n - k)), pos + 1)) AS start FROM hits
        ), counted AS (
            SELECT w.doc_id, w.item_id, w.n, w.k, w.start, d.s, count(*) AS c
            FROM windows w JOIN doc_shingles d ON d.doc_id = w.doc_id AND d.k = w.k AND d.pos BETWEEN w.start AND w.start + w.n - w.k
            GROUP BY ALL
        ), scored AS (
            SELECT doc_id, item_id, n, start, sum(least(c.c, coalesce(i.c, 0))) AS low, sum(c.c) + any_value(n - k + 1) AS total
            FROM counted c LEFT JOIN item_shingles i USING (item_id, n, k, s)
            GROUP BY doc_id, item_id, n, start
        ), alike AS (
            SELECT *, low / (total - low) AS similarity FROM scored WHERE low / (total - low) >= 0.8
        )
        SELECT doc_id, item_id, similarity, start AS start_word, n AS n_words
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place FROM alike)
        WHERE place = 1"""
}
