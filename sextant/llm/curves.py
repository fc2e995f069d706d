"""Nearest neighbours by inner product on shifted Hilbert curves.

Vectors are projected to a few directions, a different set with a different
shift for each curve, and ordered by their Hilbert keys.  Vectors of unequal
length are given one more component that makes all lengths equal, so that the
largest inner product is the smallest distance.  Spark range-partitions the
rows by (curve, key) and cuts each partition, as it streams by, into segments
of consecutive vectors.  A query searches its own segment and both neighbours
on every curve; what these windows find is merged and reranked by exact inner
products.

The windows leave each query with a score that a better candidate must reach.
Every segment of the first curve has a centre and a radius, which bound the
inner products of all its vectors, so the segments that can't reach the score
are ruled out and the rest are searched: the result is exact, and how much is
left to search depends on how far the data are clustered.  Both searches are
joins of tiles of queries with segments.

Of equal vectors only the ``k + 1`` smallest ids can be among the nearest of
anything, so copies are set aside first, before any shuffle by content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .staging import load, stage

#: Vectors that the projections and their ranges are fitted to; all are indexed.
SAMPLE = 4096
#: Leading directions of the sample, of which each curve takes a rotation of its own; directions and bits of a key.
LEADING, AXES, BITS = 24, 8, 7
#: Vectors in a segment at least; the number of segments of a curve stays below SEGMENTS and one for each partition.
SEGMENT, SEGMENTS = 512, 1 << 16
#: Queries that are searched together, and tiles of one segment in one part.
TILE, TILES = 512, 64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of ``cells`` (rows, axes), each coordinate below 2**bits."""
    x = cells.astype(np.uint64).T.copy()
    one, axes = np.uint64(1), len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(axes):
            flips = (x[i] & bit) != 0
            swap = np.where(flips, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(flips, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


@dataclass
class Curves:
    """Projections of vectors, with their added component, to the cells of several curves."""

    longest: float
    middle: np.ndarray
    directions: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, longest: float, count: int, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        raised = cls._raised(sample, longest)
        middle = raised.mean(0)
        leading = np.linalg.svd(raised - middle, full_matrices=False)[2][:LEADING]
        directions, low, width = [], [], []
        for _ in range(count):
            turn = np.linalg.qr(rng.normal(size=(len(leading), len(leading))))[0][:, :AXES]
            directions.append(leading.T @ turn)
            at = (raised - middle) @ directions[-1]
            least, most = np.quantile(at, 0.001, axis=0), np.quantile(at, 0.999, axis=0)
            spread = np.maximum(most - least, 1e-12)
            # The grid is a half wider than the data and shifted within.
            low.append(least - spread * rng.uniform(0, 0.5, at.shape[1]))
            width.append(1.5 * spread)
        return cls(longest, middle, directions, low, width)

    @staticmethod
    def _raised(vectors: np.ndarray, longest: float) -> np.ndarray:
        scaled = vectors / longest
        return np.column_stack((scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))))

    def keys(self, vectors: np.ndarray, curve: int, queries: bool) -> np.ndarray:
        """Hilbert keys; a query's place depends on its direction alone."""
        raised = np.column_stack((vectors / np.sqrt((vectors**2).sum(1))[:, None], np.zeros(len(vectors)))) if queries else self._raised(vectors, self.longest)
        at = ((raised - self.middle) @ self.directions[curve] - self.low[curve]) / self.width[curve]
        return hilbert(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed in the order of the components, whatever stands beside them."""
    total = np.zeros(len(left))
    for a, b in zip(left.T, right.T, strict=True):
        total += a * b
    return total


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _nodes(valid: DataFrame, queries: Column, k: int) -> DataFrame:
    """``node, v, ids, asked``: the different vectors with their k + 1 smallest ids, and whether any row of theirs is a query."""
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    few = valid.withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1)
    nodes = few.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))  # k + 1 ids
    asked = valid.where(queries).select("h", "v").distinct().withColumn("asked", F.lit(True))
    nodes = nodes.join(asked, ["h", "v"], "left").select("h", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    return stage(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")


def _placed(nodes: DataFrame, curves: Curves, dims: int) -> DataFrame:
    """``curve, key, tie, node, asks, v, ids``: every vector, and again every one that is a query, on each curve."""
    shared = nodes.sparkSession.sparkContext.broadcast(curves)  # a few directions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("v").type.value_type.to_pandas_dtype()
            whole = _matrix(batch.column(1), dims)
            asked = batch.column(3).to_numpy(zero_copy_only=False)
            for asks in (False, True):
                part = batch.filter(pa.array(asked)) if asks else batch
                if not part.num_rows:
                    continue
                vectors = whole[asked] if asks else whole
                blobs = pa.array([x.tobytes() for x in vectors.astype(kind)], pa.binary())
                for c in range(len(shared.value.directions)):
                    keys = shared.value.keys(vectors.astype(np.float64), c, asks)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(keys), part.column(0), pa.array(np.full(n, asks)), blobs, part.column(2)], names=["curve", "key", "node", "asks", "v", "ids"])

    return map_batches(nodes.select("node", "v", "ids", "asked"), run, "curve int, key long, node long, asks boolean, v binary, ids array<long>")


SEGMENT_SCHEMA = "curve int, part int, seg long, asks boolean, nodes binary, vectors binary, owners binary, ids binary, centre binary, radius double"


def _segments(placed: DataFrame, size: int, kind: type, dims: int) -> DataFrame:
    """Segments of the sorted partitions and, marked ``asks``, the tiles of queries that lie in them."""
    sorted_rows = placed.withColumn("tie", F.xxhash64("node")).repartitionByRange("curve", "key", "tie").sortWithinPartitions("curve", "key", "tie")
    rows = sorted_rows.select(F.spark_partition_id().alias("part"), "curve", "node", "asks", "v", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("curve", pa.int32()), ("part", pa.int32()), ("seg", pa.int64()), ("asks", pa.bool_()), *[(c, pa.binary()) for c in ("nodes", "vectors", "owners", "ids", "centre")], ("radius", pa.float64())])
        here, seg = None, 0
        held: dict[bool, tuple[list, list, list]] = {False: ([], [], []), True: ([], [], [])}

        def emit(asks: bool) -> Iterator[pa.RecordBatch]:
            nodes, vectors, ids = held[asks]
            if nodes:
                held[asks] = ([], [], [])
                x = np.frombuffer(b"".join(vectors), kind).reshape(-1, dims).astype(np.float64)
                centre = x.mean(0).astype(np.float32)
                radius = float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + 1e-12)
                owners = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
                row = {"curve": here[1], "part": here[0], "seg": seg, "asks": asks, "nodes": np.array(nodes, np.int64).tobytes(), "vectors": b"".join(vectors), "owners": owners.tobytes(), "ids": np.concatenate([np.array(i, np.int64) for i in ids]).tobytes(), "centre": centre.tobytes(), "radius": radius}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for part, curve, node, asks, v, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if here != (part, curve):
                    yield from emit(False)
                    yield from emit(True)
                    here, seg = (part, curve), 0
                for column, value in zip(held[asks], (node, v, ids), strict=True):
                    column.append(value)
                if asks and len(held[True][0]) == TILE:
                    yield from emit(True)
                elif len(held[False][0]) == size:
                    yield from emit(False)
                    yield from emit(True)
                    seg += 1
        yield from emit(False)
        yield from emit(True)

    return map_batches(rows, run, SEGMENT_SCHEMA)


def _numbered(segments: DataFrame) -> DataFrame:
    """Adds ``seq``, the place of a segment on its curve: partitions follow each other."""
    sizes = segments.groupBy("curve", "part").agg((F.max("seg") + 1).alias("n")).orderBy("curve", "part").collect()  # one row a partition and curve
    offsets, before, curve = [], 0, None
    for r in sizes:
        before = before if r.curve == curve else 0
        curve = r.curve
        offsets.append((r.curve, r.part, before))
        before += r.n
    known = segments.sparkSession.createDataFrame(offsets, "curve int, part int, offset long")
    return segments.join(F.broadcast(known), ["curve", "part"]).withColumn("seq", F.col("seg") + F.col("offset"))


FOUND = "q long, node long, vec_id long, score double"


def _search(pairs: DataFrame, k: int, dims: int, kind: type) -> DataFrame:
    """``q, node, vec_id, score``: of each tile and segment that meet, the k + 1 nearest of every query that reach its score ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asking, q, least, nodes, x, owners, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                asking, nodes, ids = (np.frombuffer(b, np.int64) for b in (asking, nodes, ids))
                owners = np.frombuffer(owners, np.int32)
                q, x = (np.frombuffer(b, kind).reshape(-1, dims).astype(np.float64) for b in (q, x))
                scores = q @ x.T
                cut = np.frombuffer(least, np.float64) if least is not None else np.full(len(q), -np.inf)
                if x.shape[0] > k + 1:
                    cut = np.maximum(cut, np.partition(scores, len(x) - k - 1, axis=1)[:, len(x) - k - 1])
                # The order of summation may differ by less than this.
                slack = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1).max())
                a, b = np.nonzero(scores >= (cut - slack)[:, None])
                if not len(a):
                    continue
                exact = inner(q[a], x[b])
                starts = np.searchsorted(owners, np.arange(len(x) + 1))
                times = np.diff(starts)[b]
                pick = np.repeat(starts[b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asking[a], times)), pa.array(np.repeat(nodes[b], times)), pa.array(ids[pick]), pa.array(np.repeat(exact, times))], names=["q", "node", "vec_id", "score"])

    return map_batches(pairs.select("asking", "q", "least", "nodes", "x", "owners", "ids"), run, FOUND)


def _best(found: DataFrame, n: int) -> DataFrame:
    """The n best rows of each query, with their ``place``."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "node")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _tiles(asking: DataFrame, blocks: DataFrame, dims: int, kind: type) -> DataFrame:
    """``seq, asking, q, least``: tiles of the queries (q, v, seq, least), one row each, that a segment may still hold candidates for."""
    summaries = blocks.select("seq", "centre", "radius").orderBy("seq").collect()  # SEGMENTS and one for each partition
    seqs = np.array([r.seq for r in summaries], np.int64)
    centres = np.frombuffer(b"".join(bytes(r.centre) for r in summaries), np.float32).reshape(-1, dims)
    radii = np.array([r.radius for r in summaries])
    shared = asking.sparkSession.sparkContext.broadcast((seqs, centres, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, centres, radii = shared.value
        centres = centres.astype(np.float64)
        longest = np.sqrt((centres**2).sum(1)) + radii
        schema = pa.schema([("seq", pa.int64()), ("asking", pa.binary()), ("q", pa.binary()), ("least", pa.binary())])
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                blobs = part.column(1).to_pylist()
                q = np.frombuffer(b"".join(blobs), kind).reshape(-1, dims).astype(np.float64)
                asks, at, least = (part.column(i).to_numpy() for i in (0, 2, 3))
                size = np.sqrt((q**2).sum(1))[:, None]
                most = q @ centres.T + size * radii + 1e-9 * size * longest
                wanted = (most >= least[:, None]) & (np.abs(at[:, None] - seqs) > 1)
                out = []
                for b in np.flatnonzero(wanted.any(0)):
                    rows = np.flatnonzero(wanted[:, b])
                    out.append({"seq": int(seqs[b]), "asking": asks[rows].tobytes(), "q": b"".join([blobs[r] for r in rows]), "least": least[rows].tobytes()})
                    if len(out) == 64:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_batches(asking.select("q", "v", "seq", "least"), run, "seq long, asking binary, q binary, least binary")


def _meet(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tiles (seq, ...) joined with the segments they name; a segment that very many tiles name is dealt over parts."""
    counts = stage(tiles.groupBy("seq").agg(F.ceil(F.count("*") / TILES).alias("parts")), "visits")  # a row for each segment
    dealt = tiles.join(F.broadcast(counts), "seq").withColumn("part", F.pmod(F.xxhash64("asking"), F.col("parts"))).drop("parts")
    each = blocks.join(F.broadcast(counts), "seq").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return dealt.join(each.hint("merge"), ["seq", "part"])


def nearest(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    curves: int = 4,
    segment: int = SEGMENT,
    seed: int = 11,
    exact: bool = True,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest inner product with each query row, its own excluded.

    ``queries`` tells query rows by ``vec_id``.  Equal scores come in the order
    of vec_id.  Vectors that are null, empty or zero or hold null or non-finite
    components take no part, nor do rows without an id.  Rows with the same id
    and vector are one row; those with the same id and different vectors are
    different rows.  Vectors of different lengths are compared as if the shorter
    one ended in zeros.  Where there are fewer candidates than k, all are
    returned; an empty table gives an empty result; other columns are ignored.
    Without ``exact`` only the windows on the curves are searched.
    """
    spark = vectors.sparkSession
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    valid = vectors.where(F.col(id_col).isNotNull() & finite & F.exists(x, lambda c: c != 0)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"), F.xxhash64(x).alias("h"))
    nodes = _nodes(valid, queries, k)
    squares = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    n, dims, longest = nodes.agg(F.count("*"), F.max(F.size("v")), F.sqrt(F.max(squares))).first()
    asked = stage(valid.where(queries).select("vec_id", "h", "v").distinct().join(nodes.select("h", "v", "node"), ["h", "v"]).select("vec_id", "node"), "asked")
    if not n:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    kind = np.float32 if nodes.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    sample = nodes.select("v").orderBy(F.xxhash64("node")).limit(SAMPLE).collect()
    fitted = np.zeros((len(sample), dims))
    for row, r in zip(fitted, sample, strict=True):
        row[: len(r.v)] = r.v
    placed = _placed(nodes, Curves.fit(fitted, longest, curves, seed), dims)
    segments = _numbered(stage(_segments(placed, max(segment, -(-n // SEGMENTS)), kind, dims), "segments"))
    blocks = segments.where("NOT asks").select("curve", "seq", "nodes", F.col("vectors").alias("x"), "owners", "ids", "centre", "radius")
    tiles = segments.where("asks").select("curve", F.col("seq").alias("at"), F.col("nodes").alias("asking"), F.col("vectors").alias("q"), F.lit(None).cast("binary").alias("least"))
    windows = tiles.withColumn("seq", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1))).join(blocks.hint("merge"), ["curve", "seq"])
    found = _best(_search(windows, k, dims, kind).dropDuplicates(["q", "vec_id", "node"]), k + 1)
    if exact:
        found = stage(found, "windows")
        # A query with fewer than k + 1 rows so far takes any.
        least = found.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("least"))
        own = _own_queries(segments.where("asks AND curve = 0"), dims, kind)
        asking = own.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        first = blocks.where("curve = 0").drop("curve")
        rest = stage(_tiles(asking.sortWithinPartitions("seq"), first, dims, kind), "tiles")
        found = _best(found.drop("place").unionByName(_search(_meet(rest, first), k, dims, kind)).dropDuplicates(["q", "vec_id", "node"]), k + 1)
    answers = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "node", "vec_id", "score"))).alias("rows"))  # k + 1 rows
    asked = asked.withColumnRenamed("vec_id", "query_id")
    others = F.filter("rows", lambda r: (r["vec_id"] != F.col("query_id")) | (r["node"] != F.col("own")))
    near = asked.withColumnRenamed("node", "own").join(answers.withColumnRenamed("q", "own"), "own").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "r"))
    return near.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def _own_queries(tiles: DataFrame, dims: int, kind: type) -> DataFrame:
    """``q, v, seq``: the queries of ``tiles``, a row each."""
    width = dims * np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, nodes, vectors in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                q = np.frombuffer(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([vectors[i : i + width] for i in range(0, len(vectors), width)], pa.binary()), pa.array(np.full(len(q), seq))], names=["q", "v", "seq"])

    return map_batches(tiles.select("seq", "nodes", "vectors"), run, "q long, v binary, seq long")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op11_nearest_neighbours": op11_nearest_neighbours}
ORACLE = {
    "op11_nearest_neighbours": """
        WITH kept AS (
            SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
            FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 20"""
}
