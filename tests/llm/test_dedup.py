"""Exact, near and substring dedup, decontamination."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import components, decontaminate, exact_dedup, near_dedup, staging, substring_dedup
from sextant.llm.hashing import shingle_hashes, word_hashes


def test_exact_against_sql(spark, documents):
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(documents).collect()}
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert rows == {r[0]: r[1:] for r in c.execute(exact_dedup.ORACLE["op6_exact_dedup"]).fetchall()}


@pytest.mark.parametrize(("keep", "best"), [("largest", 9), ("smallest", 1)])
def test_exact_cases(table, keep, best):
    docs = table([(1, "a"), (9, "a"), (9, "a"), (None, "a"), (4, None), (5, ""), (6, "A"), (None, "z"), (None, "z")])
    rows = exact_dedup.exact_groups(docs, keep=keep, bits=1).collect()
    a = [r for r in rows if r.text_sha256 == hashlib.sha256(b"a").hexdigest()]
    assert {r.keep_id for r in a} == {best} and {r.group_size for r in a} == {4} and sum(r.kept for r in a) == 1
    assert sum(r.kept for r in rows) == 4  # a, empty, A, z
    kept = exact_dedup.keep_one(docs, keep=keep)
    assert kept.columns == docs.columns and kept.count() == 4
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def slow_shingles(text, k=5):
    w = text.split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def test_hashing():
    words, first = word_hashes([b"a b a", b"", b"b \xc3\xa9c"])
    assert list(first) == [0, 3, 3, 5] and words[0] == words[2] and words[1] == words[3]
    texts = [b"a b c d e f", b"x y", b"", b"a b c d e", b"x  y", b"y x"]
    hashes, bounds = shingle_hashes(texts, 5)
    assert list(bounds) == [0, 2, 3, 3, 4, 5, 6]
    assert hashes[0] == hashes[3] and hashes[2] == hashes[4] != hashes[5]
    for few in ([b"x y"], [b""], [b"x", b"a b c"]):  # fewer words than a shingle in all
        assert shingle_hashes(few, 5)[0].tolist() == [shingle_hashes([t, b"a b c d e f"], 5)[0][0] for t in few if t]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_alignment():
    rng = random.Random(5)
    for _ in range(300):
        k = rng.choice([1, 2, 5, 50])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(40))] for _ in range(2))
        assert near_dedup.common_in_order(a, b, 99) == slow_common(a, b)
        where = {}
        for j, x in enumerate(b):
            where.setdefault(x, []).append(j)
        assert near_dedup._common_by_bits(a, where, len(b), 99) == slow_common(a, b)
        exact = slow_common(a, b) / max(1, len(a) + len(b) - slow_common(a, b))
        if a and b:
            assert (near_dedup.similarity(a, b, 0.8) >= 0.8) == (exact >= 0.8)


def test_sketches_know_order():
    forward, back = b"a b c d e f g h", b"h g f e d c b a"
    hashes, bounds = shingle_hashes([forward, forward, back], 1)
    s = near_dedup.sketches(hashes, bounds, 24, 3)
    assert (s[0] == s[1]).all() and (s[0] != s[2]).all()
    hashes, bounds = shingle_hashes([b"x x x", b"x x", b"x"], 1)
    assert len(set(near_dedup.occurrence_labels(hashes, bounds)[:3])) == 3
    assert near_dedup.sketches(hashes, bounds, 24, 3).shape == (3, 24)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100)]
    rows = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {rows[i] for i in range(41)} == {0} and rows[200] == rows[101] == 100


def test_near_groups(table):
    """Against all pairs: classes are the components of the pairs that are similar enough."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        original = [word() for _ in range(rng.randrange(60, 200))]
        texts.append(original)
        for _ in range(rng.randrange(4)):
            copy = list(original)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [[word() for _ in range(40)] + passage + [word() for _ in range(40)] for _ in range(25)]  # a shared passage is no copy
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(500, "only three words"), (501, "Only, three WORDS!"), (502, None), (503, ""), (504, " ... "), (None, rows[0][1]), (0, rows[0][1]), (505, "x " * 400), (506, "x " * 404)]
    out = {}
    for r in near_dedup.near_groups(table(rows)).collect():
        out.setdefault(r.doc_id, r)
    sets = {i: slow_shingles(t) for i, t in rows[: len(texts)]}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both and both / (sets[a].total() + sets[b].total() - both) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: out[i].class_id for i in sets} == {i: root(i) for i in sets}
    assert out[501].class_id == 500 and out[502].class_id == out[503].class_id == out[504].class_id == 502
    assert out[None].class_id == 0 and not out[None].kept and out[506].class_id == 505
    docs = table(rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.class_id for r in out.values()})
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_near_recall(spark):
    """On a whole table, all pairs at the threshold (by every shingle they share) are found, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seqs = {}
    for r in docs.select("doc_id", "text").collect():
        hashes, _ = shingle_hashes([(r.text or "").lower().encode()], 5)
        seqs[r.doc_id] = hashes.tolist()
    where, pairs = {}, Counter()
    for i, seq in seqs.items():
        for h in set(seq):
            for j in where.setdefault(h, []):
                pairs[i, j] += 1
            where[h].append(i)
    linked = [(i, j) for i, j in pairs if near_dedup.similarity(seqs[i], seqs[j], 0.8) >= 0.8]
    assert len(linked) > 50
    classes = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    recall = sum(classes[i] == classes[j] for i, j in linked) / len(linked)
    assert recall >= 0.99
    parent = {i: i for i in seqs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        parent[root(i)] = root(j)
    assert all(root(i) == root(c) for i, c in classes.items() if seqs[i])


def test_near_pairs_across_parts(table, monkeypatch):
    """Every pair that shares enough sketches is compared, though sketches are dealt out and divided."""
    compared = set()

    def links(pairs, seqs, threshold):
        compared.update((r.a, r.b) for r in pairs.collect())
        return pairs.limit(0)

    monkeypatch.setattr(near_dedup, "PART", 2)
    monkeypatch.setattr(near_dedup, "MINORS", 2)
    monkeypatch.setattr(near_dedup, "_links", links)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(24)]
    assert near_dedup.near_groups(table(list(enumerate(texts))).coalesce(1).sortWithinPartitions("doc_id")).count() == 24
    s = near_dedup.sketches(*shingle_hashes([t.encode() for t in texts], 5), 24, 3)
    assert {(a, b) for b in range(24) for a in range(b) if (s[a] == s[b]).sum() >= 5} <= compared


def test_signatures():
    """Pairs at the threshold agree, pairs well below it don't, and short texts are never told apart wrongly."""
    rng = np.random.default_rng(2)
    passed = {}
    for n in (8, 60, 400, 5000):
        for kept in (0.889, 0.6):  # of both texts' shingles: similarities 0.8 and 0.43
            ok = 0
            for _ in range(60):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                b = np.where(rng.permutation(n) < round(kept * n), a, rng.integers(0, 1 << 63, n, dtype=np.uint64))
                s = near_dedup.signatures(np.concatenate((a, b)), np.array([0, n, 2 * n]))
                differ = sum(int(x).bit_count() for x in (s[0] ^ s[1]).view(np.uint64))
                bins = near_dedup.SIGNATURE * (1 - math.exp(-2 * n / 1.8 / near_dedup.SIGNATURE))
                ok += differ <= bins * 0.1 + near_dedup.DEVIATIONS * math.sqrt(bins * 0.09) + 1
            passed[n, kept] = ok
    assert all(passed[n, 0.889] == 60 for n in (8, 60, 400, 5000))
    assert passed[400, 0.6] == 0 and passed[5000, 0.6] == 0


def test_template_pairs(spark, table, monkeypatch):
    """Texts of 40 paragraphs in one of two wordings each, hardly any of them linked: only pairs near the threshold are aligned."""
    aligned, map_batches = spark.sparkContext.accumulator(0), near_dedup.map_batches

    def counted(df, run, schema):
        def counting(rows):
            for batch in rows:
                aligned.add(batch.num_rows)
                yield from run(iter([batch]))

        return map_batches(df, counting if "left" in df.columns else run, schema)

    monkeypatch.setattr(near_dedup, "map_batches", counted)
    rng = random.Random(4)
    wordings = [[" ".join(f"p{i}v{v}w{k}" for k in range(12)) for v in range(2)] for i in range(40)]
    n = 300
    rows = [(i, " ".join(w[rng.random() < 0.2] for w in wordings)) for i in range(n)]
    assert near_dedup.near_groups(table(rows)).count() == n
    # About 20 % of all pairs share enough sketches; similarities are 0.52 on average, 0.7 and more in 3 %.
    assert aligned.value <= 0.03 * n * (n - 1) / 2


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(60):
        k = rng.choice([1, 2, 4, 26])
        data = bytes(97 + rng.randrange(k) for _ in range(rng.randrange(1, 200)))
        order = substring_dedup.suffix_array(np.frombuffer(data, np.uint8), 10_000)
        assert list(order) == sorted(range(len(data)), key=lambda i: data[i:])


def slow_removal(texts, length):
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("part", "heavy"), [(16384, 10_000), (2, 3)])
def test_remove_repeats(table, monkeypatch, part, heavy):
    monkeypatch.setattr(substring_dedup, "PART", part)
    monkeypatch.setattr(staging, "HEAVY_ROWS", heavy)
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common = [some(90) for _ in range(4)]
    texts = [some(rng.randrange(80)) + "".join(rng.choice(common)[rng.randrange(20) :] + some(rng.randrange(5)) for _ in range(rng.randrange(4))) for _ in range(60)]
    texts += ["ab" * 200, texts[5], "", None, "short", texts[6] + texts[6], "q" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7])]
    length = 60
    gone = slow_removal([(t or "").encode() for _, t in rows], length)
    expected = sorted((-1 if i is None else i, len(g), int(g.sum()), hashlib.sha256(bytes(np.frombuffer((t or "").encode(), np.uint8)[~g])).hexdigest()) for (i, t), g in zip(rows, gone))
    out = substring_dedup.remove_repeats(table(rows), length=length).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out) == expected
    assert substring_dedup.remove_repeats(table(rows).limit(0)).count() == 0


def test_repeats_in_a_long_text(table):
    """A text of 17 MB, read in slices, against short ones that share a passage with it, also where slices meet."""
    rng = np.random.default_rng(2)
    long = bytearray(rng.integers(97, 123, 17 << 20, dtype=np.uint8).tobytes())
    places = [0, 1000, (1 << 20) - 150, 5 << 20, (3 << 20) - 1, len(long) - 260]
    rows = [(0, long.decode())] + [(k + 1, f"{k} <{long[p : p + 260].decode()}>") for k, p in enumerate(places)] + [(9, f"<{long[7000:7199].decode()}>")]
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(table(rows)).collect()}
    assert [(s.start, s.stop) for s in out[0].removed] == [(p, p + 260) for p in sorted(places)]
    assert [bytes(out[k + 1].kept) for k in range(len(places))] == [f"{k} <>".encode() for k in range(len(places))] and not out[9].removed


def test_twice():
    """Batches of a sorted run, however cut, give the rows whose digest occurs more than once."""
    rng = random.Random(9)
    for _ in range(50):
        run = sorted((rng.randrange(6), rng.randrange(3)) for _ in range(rng.randrange(1, 40)))
        table = pa.table({"w1": pa.array([r[0] for r in run], pa.int64()), "w2": pa.array([r[1] for r in run], pa.int64()), "at": list(range(len(run)))})
        found = [x for b in substring_dedup.twice(iter(table.to_batches(max_chunksize=rng.randrange(1, 6)))) for x in b["at"].to_pylist()]
        assert found == [i for i, r in enumerate(run) if run.count(r) > 1]


def test_leaks_against_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    expected = sorted((a, b, round(x, 9), s, n) for a, b, x, s, n in c.execute(decontaminate.ORACLE["op10_decontamination"]).fetchall())
    out = decontaminate.op10_decontamination(spark, d).collect()
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in out) == expected


def test_leak_cases(table):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew ample potions near the quiet river bank at dawn today again and again"
    words = item.split()
    changed = " ".join([*words[:-1], "never"])
    bench = table([(1, item), (2, "two words"), (3, None), (4, " ".join(f"w{i}" for i in range(300))), (1, item)], "item_id long, text string")
    rows = [(1, f"before. {item.upper()}! after"), (2, changed), (3, " ".join(words[:12])), (4, "say two, words now"), (5, None), (6, ""), (None, item), (7, "x " * 50 + " ".join(f"w{i}" for i in range(300))), (1, f"before. {item.upper()}! after")]
    docs = table(rows)
    for bound in (500_000, 0):
        out = {(r.doc_id, r.item_id): (r.start_word, r.n_words) for r in decontaminate.find_leaks(docs, bench, broadcast_rows=bound).collect()}
        assert out == {(1, 1): (1, len(words)), (2, 1): (0, len(words)), (4, 2): (1, 2), (None, 1): (0, len(words)), (7, 4): (50, 300)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).select("doc_id").collect()) == [3, 5, 6]
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_radius_and_similarity():
    """Windows at the similarity 0.8 are practically always within radius 23."""
    rng = np.random.default_rng(4)
    for n in (9, 18, 27, 45, 90):  # shingles of an item; at 0.8 a ninth of them differ
        beyond, trials = 0, 20_000
        for _ in range(trials // 1000):
            shared = rng.integers(0, 2, (1000, n - n // 9, 64), dtype=np.int8).sum(1, dtype=np.int16)
            own = [rng.integers(0, 2, (1000, n // 9, 64), dtype=np.int8).sum(1, dtype=np.int16) for _ in range(2)]
            beyond += ((((shared + own[0]) > n // 2) != ((shared + own[1]) > n // 2)).sum(1) > 23).sum()
        assert beyond / trials < 5e-4, n


def test_leaks_without_broadcast(spark, table):
    """The way for benchmarks too large to be broadcast finds the same."""
    d = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda rows: sorted((r.doc_id, r.item_id, r.start_word) for r in rows.collect())
    assert key(decontaminate.find_leaks(docs, bench, broadcast_rows=0)) == key(decontaminate.find_leaks(docs, bench))


def test_simhash_radius(spark):
    """Blocks of windows and items agree with fingerprints computed bit by bit."""
    rng = np.random.default_rng(1)
    rows = [(rng.integers(-(2**63), 2**63, n).tolist(),) for n in (1, 2, 7, 60, 61, 500)]
    frame = spark.createDataFrame(rows, "h array<long>").withColumn("v", decontaminate.lanes(F.col("h")))
    for hashes, blocks in frame.where("size(h) <= 60").select("h", decontaminate.simhash_blocks(F.col("v"), 60)).collect():
        bits = np.array([[h >> b & 1 for b in range(64)] for h in hashes]).sum(0) > len(hashes) // 2
        assert blocks == [sum(int(bits[8 * b + j]) << 7 * j for j in range(8)) for b in range(8)]
    assert frame.select(decontaminate.simhash_blocks(F.col("v"), 500).alias("b")).where("size(b) = 8").count() == 6
