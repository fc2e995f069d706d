"""Near-duplicate classes by Order MinHash.

A text is the sequence of its k-word shingles, each labelled with its
occurrence number.  A sketch orders all labelled shingles by a seeded hash,
takes the ``picks`` smallest and keeps them in text order, so two texts share
it with high probability only if they have the same shingles in the same
order.  Texts that share a sketch are candidates; they are linked if a banded
alignment of their shingle sequences finds at least ``threshold`` of all
shingles common in order: c / (n + m - c) for the longest common subsequence
c.  Classes are the connected components of the links.

Texts with equal sequences are one node from the start.  A shingle that no
other candidate has can't be common to two texts, so the number of such
shingles bounds every similarity of a text; texts that only share a passage
drop out by it, without a comparison and without losing a link.  Of the texts
of one sketch the one most like the rest is compared with all others; then
texts that are not yet of one class are compared with their neighbours in
size, and what is left of different classes with each other, so a class of
thousands costs about one comparison a member, and no pair of different
classes that may be linked and shares ``in_common`` sketches stays uncompared.
A large sketch with many texts outside its main class is divided by the
further sketches that its texts share, which all those pairs have.

Before it is aligned, a pair must agree in a signature of SIGNATURE
bits, one for the least shingle hash of each bin: texts of one template that
differ in many places share sketches, but their signatures tell them apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .components import merge_labels
from .hashing import batches, mix, shingle_hashes
from .staging import load, small, stage, text_hash, without_unkept

#: A sketch shared by more texts than this is dealt out in parts; texts outside its main class meet all parts.
PART = 2048
#: A group with more texts than this outside its main class is divided by further sketches.
MINORS = 256
#: Bits of a signature, and standard deviations beyond the expected number of differing bits that a pair may have.
SIGNATURE, DEVIATIONS = 512, 4.5


def occurrence_labels(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each shingle's hash joined with how often it occurred before in its text."""
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    own = mix(hashes + text * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[order][1:] != own[order][:-1]
    at = np.arange(len(own))
    times = np.empty(len(own), np.uint64)
    times[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(hashes + times * np.uint64(0xD6E8FEB86659FD93))


def sketches(hashes: np.ndarray, bounds: np.ndarray, count: int, picks: int) -> np.ndarray:
    """(texts, count) sketches of texts that have at least one shingle."""
    labelled = occurrence_labels(hashes, bounds)
    sizes = np.diff(bounds)
    local = (np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)).astype(np.uint64)
    shift = np.uint64(max(int(sizes.max()).bit_length(), 1))
    low = (np.uint64(1) << shift) - np.uint64(1)
    out = np.empty((len(sizes), count), np.uint64)
    for j in range(count):
        ranks = (mix(labelled + np.uint64((j + 1) * 0xA0761D6478BD642F % (1 << 64))) & ~low) | local
        taken = []
        for pick in range(picks):
            least = np.minimum.reduceat(ranks, bounds[:-1])
            place = (least & low).astype(np.int64) + bounds[:-1]
            some = sizes > pick
            taken.append(np.where(some, place, np.iinfo(np.int64).max))
            ranks[place[some]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places = np.sort(np.array(taken), axis=0)  # back into text order
        value = np.full(len(sizes), j + 1, np.uint64)
        for row in places:
            some = row < len(hashes)
            value = np.where(some, mix(value * np.uint64(31) + labelled[np.where(some, row, 0)]), value)
        out[:, j] = value
    return out


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, SIGNATURE / 64) bits: shingles fall into bins by their labelled hash, and each bin has a bit of its least one."""
    labelled = mix(occurrence_labels(hashes, bounds) + np.uint64(0x2545F4914F6CDD1D))
    out = np.empty((len(bounds) - 1, SIGNATURE // 64), np.int64)
    for start in range(0, len(out), 2048):  # short texts come in large numbers
        own = bounds[start : start + 2049]
        values, n = labelled[own[0] : own[-1]], len(own) - 1
        at = np.repeat(np.arange(n, dtype=np.int64), np.diff(own)) * SIGNATURE + (values % np.uint64(SIGNATURE)).astype(np.int64)
        least = np.full(n * SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, at, values >> np.uint64(10))
        bits = (mix(least) & np.uint64(1)).astype(np.uint8)
        out[start : start + 2048] = np.packbits(bits.reshape(n, -1), axis=1, bitorder="little").view("<i8").reshape(n, -1)
    return out


def may_agree(threshold: float) -> Column:
    """Whether the signatures ``sig`` and ``other_sig`` of texts with n and m shingles may be those of a pair at the threshold.

    A bin that holds a shingle of either has its least one in both texts with
    a probability of the threshold at least; otherwise its bits differ by chance.
    """
    differ = reduce(Column.__add__, [F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("other_sig")[i])) for i in range(SIGNATURE // 64)])
    bins = SIGNATURE * (1 - F.exp(-(F.col("n") + F.col("m")) / (1 + threshold) / SIGNATURE))
    chance = (1 - threshold) / 2
    return differ <= bins * chance + DEVIATIONS * F.sqrt(bins * chance * (1 - chance)) + 1


def _rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sketch_table(docs: DataFrame, words: int, count: int, picks: int) -> DataFrame:
    """``doc_id, row, text_hash, n, same, sketches`` of ``docs`` (doc_id, row, text_hash, text); ``same``: digest of the whole sequence."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("same", pa.list_(pa.int64())), ("sketches", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(rows, lower=True):
            hashes, bounds = shingle_hashes(texts, words)
            n = np.diff(bounds)
            have = n > 0
            found = np.zeros((len(n), count), np.uint64)
            if have.any():
                found[have] = sketches(hashes, np.concatenate((bounds[:-1][have], bounds[-1:])), count, picks)
            signed = found.view(np.int64)
            yield _rows(schema, [*[[k[i] for k in keys] for i in range(3)], n, list(digests(hashes, bounds).view(np.int64)), [s if h else [] for s, h in zip(signed, have, strict=True)]])

    return map_batches(docs, run, "doc_id long, row long, text_hash long, n long, same array<long>, sketches array<long>")


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 2) digests of the whole sequences; 0 where there is none."""
    n = np.diff(bounds)
    have = n > 0
    out = np.zeros((len(n), 2), np.uint64)
    local = (np.arange(len(hashes)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
    for c, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F) if have.any() else ()):
        out[have, c] = np.add.reduceat(mix(hashes + local * np.uint64(odd)), bounds[:-1][have])
    return out


def sequence_table(docs: DataFrame, words: int) -> DataFrame:
    """``node, seq, n, sig``: the shingle hashes in order, their number and the signature of those ``docs`` (node, same, text) whose digest is ``same``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(rows, lower=True):
            hashes, bounds = shingle_hashes(texts, words)
            fits = (digests(hashes, bounds).view(np.int64) == np.array([k[1] for k in keys])).all(1)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), lists], names=["node", "seq"])
            sig = pa.array(list(signatures(hashes, bounds)), pa.list_(pa.int64()))
            batch = batch.append_column("n", pa.array(np.diff(bounds), pa.int64())).append_column("sig", sig)
            yield batch.filter(pa.array(fits))

    return map_batches(docs, run, "node long, seq array<long>, n long, sig array<long>")


def common_in_order(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence with |i - j| <= band (of the part that differs)."""
    lead = 0
    most = min(len(a), len(b))
    while lead < most and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < most - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not a or not b:
        return lead + tail
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    if sum(len(where.get(x, ())) for x in a) > 8 * (len(a) + len(b)):
        return lead + tail + _common_by_bits(a, where, len(b), band)
    ends: list[int] = []  # ends[c]: least end in b of a common subsequence of length c + 1
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            if -band <= i - j <= band:
                at = bisect_left(ends, j)
                ends[at : at + 1] = [j]
    return lead + tail + len(ends)


def _common_by_bits(a: list[int], where: dict[int, list[int]], m: int, band: int) -> int:
    """The same for texts with many repeats: one bit for each place of b."""
    masks = {x: sum(1 << j for j in places) for x, places in where.items()}
    full = (1 << m) - 1
    row = full
    for i, x in enumerate(a):
        lo, hi = max(0, i - band), min(m, i + band + 1)
        match = masks.get(x, 0) & ((1 << hi) - (1 << lo) if hi > lo else 0)
        both = row & match
        row = ((row + both) | (row - both)) & full
    return m - row.bit_count()


def similarity(a: list[int], b: list[int], threshold: float) -> float:
    """Share of the shingles that are common in order; 0 where it can't reach the threshold."""
    n, m = len(a), len(b)
    if min(n, m) < threshold * max(n, m):
        return 0.0
    # At the threshold at most this many shingles of both stand alone, so no path leaves the band.
    band = int((n + m) * (1 - threshold) / (1 + threshold)) + 1
    c = common_in_order(a, b, band)
    return c / (n + m - c)


def _links(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` that are similar; only pairs whose signatures agree are aligned."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start in range(0, batch.num_rows, 256):
                a, b, left, right = [c.to_pylist() for c in batch.slice(start, 256).columns]
                kept = [i for i in range(len(a)) if similarity(left[i], right[i], threshold) >= threshold]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in (a, b)], names=["a", "b"])

    of = lambda side, n, sig, seq: seqs.select(F.col("node").alias(side), F.col("n").alias(n), F.col("sig").alias(sig), F.col("seq").alias(seq))
    both = pairs.join(of("a", "n", "sig", "left"), "a").join(of("b", "m", "other_sig", "right"), "b").where(may_agree(threshold))
    return map_batches(both.select("a", "b", "left", "right"), run, "a long, b long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    count: int = 24,
    picks: int = 3,
    in_common: int = 5,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """``doc_id, class_id, class_size, kept``: one row per input row.

    ``class_id`` is the least doc_id of the class, and that row is kept (one
    row of them if it repeats).  Words are runs of letters, digits, _ and
    non-ASCII characters in lower case; texts of fewer than ``words`` words are
    one shingle; texts without a word, empty and null ones included, are one
    class.  A null doc_id is a document like others, last in order.  An empty
    table gives an empty result; other columns are ignored.

    A pair at the threshold shares each sketch with a probability of about
    p = threshold ** picks, so the number of sketches it shares is binomial: by
    default it is less than 5 of 24 with 0.0005, more rarely for closer pairs.
    """
    return _groups(docs, id_col, text_col, words, threshold, count, picks, in_common, broadcast_rows).drop("text_hash")


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, count: int = 24, picks: int = 3, in_common: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """near_groups() with the hash of each text."""
    # Equal rows are told apart by a number of their own, given once.
    own = F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("doc_id"), own.alias("row"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    table = stage(sketch_table(base, words, count, picks), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")
    # One node for each sequence: its first document's row.
    same = table.groupBy("same", "n").agg(F.min(first).alias("first"), F.min_by("sketches", first).alias("sketches"))
    same = stage(same.select("same", "n", F.col("first.row").alias("node"), F.col("first.doc_id").alias("node_doc"), F.col("first.text_hash").alias("node_hash"), "sketches"), "nodes")

    shared = same.select("node", "n", F.posexplode("sketches").alias("j", "value"))
    sizes = shared.groupBy("j", "value").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(shared.join(sizes.select("j", "value"), ["j", "value"]), "members")
    wanted = same.join(members.select("node").distinct(), "node").select("node", "node_doc", "node_hash", "same")
    wanted = small(stage(wanted, "wanted"), broadcast_rows)
    texts = base.drop("row").join(wanted, F.col("doc_id").eqNullSafe(F.col("node_doc")) & (F.col("text_hash") == F.col("node_hash"))).select("node", "same", "text")
    seqs = stage(sequence_table(texts, words).dropDuplicates(["node"]), "sequences")

    # Shingles that no other candidate has bound what a text can have in common with any.
    owners = seqs.select("node", F.explode("seq").alias("h")).groupBy("h").agg(F.count("*").alias("times"), F.min("node").alias("node"), F.max("node").alias("last"))
    alone = owners.where("node = last").groupBy("node").agg(F.sum("times").alias("alone"))
    able = same.select("node", "n").join(alone, "node", "left").select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    able = stage(members.select("node", "n").distinct().join(able, "node").where(F.col("most") >= threshold * F.col("n")), "able")
    # With so much in common at most, a text can only be linked to texts of at most this size.
    limit = F.floor(F.col("most") * (1 + threshold) / threshold - F.col("n") + 1e-9)
    members = members.join(able.select("node", "most"), "node").withColumn("limit", limit)
    sizes = members.groupBy("j", "value").agg(F.min("n").alias("least"), F.max("limit").alias("most_limit"))
    members = members.join(sizes, ["j", "value"]).where("least <= limit AND n <= most_limit").drop("least", "most_limit", "limit")
    sizes = members.groupBy("j", "value").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(members.join(sizes, ["j", "value"]), "open_members")
    # The first text of a sketch is the one whose sketches most others share: in a class of copies the original.
    fame = members.groupBy("node").agg(F.sum("size").alias("fame"))
    heads = members.join(fame, "node").groupBy("j", "value").agg(F.max(F.struct("fame", (-F.col("node")).alias("back"))).alias("head"))
    members = members.join(heads.select("j", "value", (-F.col("head.back")).alias("head")), ["j", "value"])
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART).cast("long"))
    members = stage(members.select("j", "value", part.alias("part"), "node", "n", "most", "head"), "parts")

    both = F.least(F.col("most"), F.col("other_most"))
    may_link = both >= threshold * (F.col("n") + F.col("m") - both)
    head_sizes = able.select(F.col("node").alias("head"), F.col("n").alias("m"), F.col("most").alias("other_most"))
    pairs = members.where("node != head").select("node", "n", "most", "head").distinct().join(head_sizes, "head")
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = pairs.where(may_link).select(F.col("head").alias("a"), F.col("node").alias("b")).select(low, high).distinct()
    pairs = stage(pairs, "pairs")
    compared = pairs
    links = stage(_links(pairs, seqs, threshold), "links")
    labels = merge_labels(members.select(F.col("node").alias("id"), F.col("node").alias("label")).distinct(), links)
    # Neighbours among the texts of a part, by size; then all texts of a sketch, whatever their part.
    place = F.row_number().over(Window.partitionBy("j", "value", "part").orderBy("n", "node"))
    own = same.select("node", F.col("sketches").alias("own"))
    members = stage(members.join(own, "node").select("j", "value", "part", place.alias("place"), "node", "n", "most", "own"), "places")
    key = ["j", "value", "part"]
    met = F.zip_with("own", "others", lambda x, y: x == y)
    others = [F.col("node").alias("a"), F.col("n").alias("m"), F.col("most").alias("other_most"), F.col("label").alias("other"), F.col("own").alias("others")]
    times = lambda flags: F.size(F.filter(flags, lambda m: m))

    def link(found: DataFrame) -> None:
        nonlocal compared, labels
        pairs = stage(found.select(low, high).distinct().join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = compared.unionByName(pairs)
        more = stage(_links(pairs, seqs, threshold), "links")
        if not more.isEmpty():
            labels = merge_labels(labels, more)

    for reach in (4, 64):
        labelled = members.join(labels.withColumnRenamed("id", "node"), "node")
        mixed = labelled.groupBy(*key).agg(F.mode("label", True).alias("main"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        open_ = stage(labelled.join(mixed.select(*key, "main"), key), "mixed")
        # Of two texts of different classes one at least isn't of the part's main class.
        minor = open_.where("label != main").select(*key, "place", F.col("node").alias("b"), "n", "most", "label", "own")
        other = open_.select(*key, F.col("place").alias("there"), *others)
        # A pair is followed where it first meets; linked pairs nearly always meet more often.
        often = (F.array_position(met, F.lit(True)) == F.col("j") + 1) & (times(met) >= in_common)
        close = F.abs(F.col("place") - F.col("there")) <= reach
        link(minor.join(other, key).where((F.col("label") != F.col("other")) & may_link & close & often))

    groups = members.select("j", "value", "node", "n", "most", "own")
    found = []
    for depth in range(1, in_common + 1):
        # Each group shares ``depth`` sketches, the last of them j.
        labelled = groups.join(labels.withColumnRenamed("id", "node"), "node")
        classes = labelled.groupBy("j", "value", "label").agg(F.count("*").alias("texts"))
        mixed = classes.groupBy("j", "value").agg(F.sum("texts").alias("size"), F.max(F.struct("texts", "label")).alias("main")).where("size > main.texts")
        mixed = mixed.select("j", "value", F.col("main.label").alias("main"), (F.col("size") - F.col("main.texts")).alias("minors"), F.ceil(F.col("size") / PART).cast("long").alias("parts"))
        open_ = stage(labelled.join(mixed, ["j", "value"]), "mixed")
        divided = depth < in_common and not open_.where(F.col("minors") > MINORS).isEmpty()
        whole = open_.where(F.col("minors") <= MINORS) if divided else open_
        minor = whole.where("label != main").select("j", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("node").alias("b"), "n", "most", "label", "own")
        other = whole.select("j", "value", F.pmod(F.xxhash64("node"), "parts").alias("part"), *others)
        # A pair is followed in the group of the first sketches that it shares.
        often = F.element_at(met, (F.col("j") + 1).cast("int")) & (times(F.slice(met, F.lit(1), (F.col("j") + 1).cast("int"))) == depth) & (times(met) >= in_common)
        found.append(stage(minor.join(other, key).where((F.col("label") != F.col("other")) & may_link & often).select("a", "b"), "found"))
        if not divided:
            break
        further = open_.where(F.col("minors") > MINORS).select(F.col("j").alias("last"), F.col("value").alias("shared"), "node", "n", "most", "own", F.posexplode("own").alias("j", "next"))
        # Enough sketches must follow for ``in_common``.
        further = further.where((F.col("j") > F.col("last")) & (F.col("j") <= count - in_common + depth))
        groups = stage(further.select("j", F.xxhash64("last", "shared", "next").alias("value"), "node", "n", "most", "own"), "further")
    link(reduce(DataFrame.unionByName, found))

    nodes = same.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = table.join(nodes.select("same", "n", "label"), ["same", "n"]).select("doc_id", "row", "text_hash", "label")
    rows = stage(rows, "classes")
    sizes = rows.groupBy("label").agg(F.min(first).alias("first"), F.count("*").alias("class_size"))
    return rows.join(sizes, "label").select("text_hash", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    return without_unkept(docs, id_col, text_col, _groups(docs, id_col, text_col))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLE: dict[str, str] = {}
