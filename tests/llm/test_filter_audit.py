import random
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest

from sextant.llm import filter_audit
from sextant.llm.filter_audit import _mark_copies, audit, effects, masks


def failing(text, copy):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": copy,
    }


def brute(docs, labels):
    """Counts by walking through every order for every document."""
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, quality, bad in labels:
        if i is not None:
            good |= {i} if quality == 1 else set()
            toxic |= {i} if bad == 1 else set()
    out, removed = defaultdict(Counter), Counter()
    for i, text, part in docs:
        fails = failing(text or "", i is not None and i > first[text or ""])
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                row = out[part or "", "".join(order), step]
                row.update(kept=not gone and not fails[x], removed=not gone and fails[x], redundant=gone and fails[x], unique_fails=fails[x] and sum(fails.values()) == 1)
                row.update(good_lost=not gone and fails[x] and i in good, toxic_lost=not gone and fails[x] and i in toxic)
                removed[part or "", x] += not gone and fails[x]
                gone = gone or fails[x]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {k: (*(v[n] for n in names), removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def some_docs():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "ein", "zwei", "$5", "x#y", "\x0b", "two words", "ÄÖ", "𝔘"]
    texts = [None, "", " \t\n", "A", "a" * 40, "AB " * 300, *(" ".join(rng.choices(words, k=n)) for n in (3, 199, 200, 201, 400)), " ".join(f"w{k}" for k in range(250))]
    docs = [(k, rng.choice(texts), rng.choice([None, "en", "de", ""])) for k in range(120)]
    docs += [(5, docs[5][1], "en"), (None, texts[6], "en"), (None, texts[6], "de"), (7, "another text", "en"), (-4, texts[8], "en")]
    rng.shuffle(docs)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_equals_every_order_walked_through(spark):
    docs, labels = some_docs()
    table = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, lang string, mask int, part string").repartition(5)
    found = of(audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = audit(spark.createDataFrame([(1, None, None)], docs.schema), labels)
    assert of(one)["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one.count() == 600


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_copies_across_partitions(spark, partitions):
    """A hot text, few others and a repeated id, cut by very many edges."""
    rng = random.Random(partitions)
    docs = [(k, "hot" if rng.random() < 0.5 else f"text {rng.randrange(30)}", "en") for k in range(300)] + [(3, "hot", "en")] * 50
    rng.shuffle(docs)
    first = {}
    for i, text, _ in docs:
        first[text] = min(i, first.get(text, i))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6)
    found = Counter((r.doc_id, bool(r["mask"] & filter_audit.DUPLICATE)) for r in masks(table, partitions=partitions).collect())
    assert found == Counter((i, i > first[text]) for i, text, _ in docs)


def test_texts_of_one_fingerprint():
    """Different texts with equal fingerprints are told apart, in batches of any size."""
    rows = sorted([(7, t, i) for t in ("a", "b") for i in range(4)] + [(9, "c", 1), (9, "c", 2)])
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_pylist([{"fp": f, "text": t, "doc_id": i, "part": "", "mask": 0} for f, t, i in rows[k : k + size]], schema=pa.schema([("fp", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32())])) for k in range(0, len(rows), size)]
        out = [r for b in _mark_copies(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["fp"], r["doc_id"], r["mask"]) for r in out) == sorted((f, i, 16 if i > (1 if f == 9 else 0) else 0) for f, t, i in rows)
        assert sum(r["digest"] is not None for r in out) == 3


def test_effects():
    rows = effects()
    assert len(rows) == 32 * 600
    for mask in (0, 0b1, 0b10110, 0b11111):
        own = [r for r in rows if r[0] == mask]
        assert sum(r[4] for r in own) == (120 if mask else 0)  # each order removes it once
        assert sum(r[7] for r in own if r[1] == "ABCDE") == (120 if mask else 0)
