"""Toxicity, pseudo-likelihood, piece encoding and the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import pieces, pseudo_likelihood, toxicity
from sextant.llm.hashing import word_hashes


@pytest.fixture(scope="module")
def insults(table):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    sentence = lambda bad: " ".join([word() for _ in range(6)] + (["scoundrel"] if bad else [])) + "."
    rows = [(i, " ".join(sentence(i % 3 == 0 and k == 2) for k in range(6)), int(i % 3 == 0)) for i in range(400)]
    return table([r[:2] for r in rows]), table([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_toxicity(spark, insults, table):
    docs, labels, truth = insults
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()}
    unseen = [r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()]
    assert len(unseen) > 50
    assert np.mean([(out[i].score >= 0.3) == bool(truth[i]) for i in unseen]) > 0.97
    bad = next(i for i in unseen if truth[i])
    assert ["scoundrel" in out[bad].text[s.start : s.end] for s in out[bad].offending] == [True]
    edge = table([(1, None), (2, ""), (3, "..."), (None, "scoundrel"), (None, "scoundrel"), (4, "x " * 100_000)])
    scores = [(r.doc_id, r.score) for r in toxicity.score_documents(edge, model).collect()]
    assert dict(scores)[1] == dict(scores)[2] == 0 and sum(s > 0.3 for _, s in scores) == 2
    kept = toxicity.drop_toxic(edge, model)
    assert kept.columns == edge.columns and kept.count() == 4
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_documents(docs, nothing).agg(F.max("score")).first()[0] < 0.3
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_repeated_ids(table):
    """Of several texts of one id always the same one teaches, and an empty text scores plain 0."""
    rows = [(i, f"{'scoundrel ' * (i % 3 == 0)}text {i}{x}.") for i in range(90) for x in "ab"]
    labels = table([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    models = [toxicity.train(table(r), labels) for r in (rows, rows[::-1])]
    assert models[0].weights == models[1].weights and models[0].bias == models[1].bias
    assert str(toxicity.score("", models[0], 0.3)[0]) == "0.0"


def test_held_out_labels_are_not_learnt(insults):
    docs, labels, _ = insults
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels).weights == pytest.approx(toxicity.train(docs, turned).weights)


def test_gradients():
    rng = np.random.default_rng(0)
    model = {k: rng.standard_normal(s) * 0.1 for k, s in pseudo_likelihood.SHAPES.items()}
    tokens = rng.integers(0, pseudo_likelihood.TOKENS, 60)
    near = pseudo_likelihood.neighbours(tokens, np.array([0, 20, 20, 60]))
    assert near[1][0] == near[2][19] == near[1][20] == pseudo_likelihood.EDGE and near[1][5] == tokens[4]
    grad = pseudo_likelihood.gradients(model, tokens, near)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        moved = []
        for e in (1e-4, -1e-4):
            other = {q: v.copy() for q, v in model.items()}
            other[k][at] += e
            moved.append(pseudo_likelihood.log_probabilities(other, tokens, near).mean())
        assert g[at] == pytest.approx((moved[0] - moved[1]) / 2e-4, rel=1e-3)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = {k: rng.standard_normal(s).astype(np.float32) for k, s in pseudo_likelihood.SHAPES.items()}
    tokens = np.arange(pseudo_likelihood.TOKENS)
    near = np.full((4, len(tokens)), 17)
    assert np.exp(pseudo_likelihood.log_probabilities(model, tokens, near)).sum() == pytest.approx(1, abs=1e-3)


def test_pseudo_likelihood(table):
    rng = random.Random(4)
    cycle = "one two three four five six seven eight".split()
    rows = [(i, " ".join(cycle[(i + k) % 8] for k in range(60))) for i in range(300)]
    rows += [(1000, " ".join(rng.choice(cycle) for _ in range(60))), (1001, None), (1002, ""), (None, "one two")]
    out = {r.doc_id: r for r in pseudo_likelihood.score_documents(table(rows)).collect()}
    assert out[5].mean_log_likelihood > np.log(1 / 8) + 0.5 > out[1000].mean_log_likelihood  # better than frequencies alone
    assert out[5].log_likelihood == pytest.approx(60 * out[5].mean_log_likelihood)
    assert out[1001].n_tokens == out[1002].n_tokens == 0 and out[1001].mean_log_likelihood is None and out[None].n_tokens == 2
    assert pseudo_likelihood.score_documents(table(rows).limit(0)).count() == 0


def test_word_probabilities(table, monkeypatch):
    """Against sums by hand: the network's probability of the token, and of a bucket's word its share by count."""
    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(pseudo_likelihood.KNOWN)], [f"r{i}" for i in range(3000)]
    texts = [" ".join(common), " ".join(common), " ".join(common[:50] + ["once"]), *(" ".join(rng.choice(rare) for _ in range(3)) for _ in range(800)), None, "", "r1 r1 r1 c1"]
    docs = table([*enumerate(texts), (2, texts[2])])
    words, counts = pseudo_likelihood.vocabulary(docs, "text")
    model = pseudo_likelihood.initial(words.counts, 1)
    monkeypatch.setattr(pseudo_likelihood, "train", lambda *_: model)
    times = Counter(w for t in [*texts, texts[2]] for w in (t or "").split())
    token = {w: int(words.tokens(word_hashes([w.encode()])[0])[0]) for w in times}
    known = pseudo_likelihood.KNOWN
    inside = {t: [w for w in times if token[w] == t] for t in set(token.values()) if t >= known}
    assert counts.count() == len(times) and inside

    def share(w):
        if token[w] < known:
            return 1.0
        ws = inside[token[w]]
        return (times[w] + 0.5) / (sum(times[x] for x in ws) + 0.5 * (len(ws) + 1))

    assert all(sum(share(w) for w in ws) < 1 for ws in inside.values())
    out = {}
    for r in pseudo_likelihood.score_documents(docs).collect():
        out.setdefault(r.doc_id, []).append(r.log_likelihood)
    for i, t in enumerate(texts):
        ws = (t or "").split()
        ids = np.array([token[w] for w in ws], np.int64)
        net = pseudo_likelihood.log_probabilities(model, ids, pseudo_likelihood.neighbours(ids, np.array([0, len(ws)])))
        assert out[i] == pytest.approx([net.sum() + sum(math.log(share(w)) for w in ws)] * (2 if i == 2 else 1), rel=1e-5)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(pieces.MODEL)


def all_cuts(word, v):
    if not word:
        yield ()
        return
    for end in range(1, len(word) + 1):
        if word[:end] in v.ids:
            yield from ((v.ids[word[:end]], *rest) for rest in all_cuts(word[end:], v))
    if word[0] not in v.ids:
        yield from ((-1, *rest) for rest in all_cuts(word[1:], v))


def test_n_best(vocabulary, documents):
    v, rng = vocabulary, random.Random(1)
    words = sorted({w for r in documents.limit(60).collect() for w in r.text.split() if 1 < len(w) < 8})
    encoder, spelling = pieces.Encoder(v, 4), pieces.spellings(v)
    for _ in range(60):
        text = " ".join(rng.sample(words, 2))
        scores = sorted((sum(v.score[p] for cut in cuts for p in cut) for cuts in itertools.product(*[list(all_cuts(pieces.MARK + w, v)) for w in text.split()])), reverse=True)[:4]
        ids, score, others = next(encoder.encode([text]))
        assert [score, *[s for s, _ in others]] == pytest.approx(scores)
        for s, changes in others:
            parts = [np.frombuffer(encoder.ids[encoder.index[w]], "<i4").tolist() for w in pieces.words_of(text)]
            for at, new in changes:
                parts[at] = new
            assert pieces.decode([i for p in parts for i in p], spelling) == text
            assert sum(v.scores[i] for p in parts for i in p) == pytest.approx(s)


def test_round_trip(spark, documents, table, vocabulary):
    odd = [(-1, ""), (-2, None), (-3, " "), (-4, "  a\tb\n\n▁c 😀 "), (-5, "▁"), (-6, "y" * 3000), (-7, "\x00\x7f"), (-7, "same"), (-7, "same")]
    docs = documents.select("doc_id", "text").unionByName(table(odd).select("doc_id", "text"))
    encoded = pieces.encode_pieces(docs).cache()
    decoded = pieces.decode_pieces(encoded)
    key = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    assert key(decoded) == key(docs)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert rows[-1].ids == [] and rows[-1].score == 0 and rows[-1].alternatives == []
    assert all(a.score <= rows[3].score + 1e-6 for a in rows[3].alternatives) and len(rows[3].alternatives) == 3
    encoded.unpersist()
    assert pieces.encode_pieces(docs.limit(0)).count() == 0 and pieces.decode_pieces(encoded.limit(0)).count() == 0


def test_ties_have_an_order(vocabulary):
    """Words with many segmentations of one score come out the same in any batch."""
    texts = ["\x01\x02 \x01\x02 \x01\x02", "aaaa aaaa aaaa aaaa", "ab ab ab"]
    alone = [next(pieces.Encoder(vocabulary, 4).encode([t])) for t in texts]
    assert list(pieces.Encoder(vocabulary, 4).encode(texts[::-1]))[::-1] == alone


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left, seen = docs, []
    for name, step in corpus_pipeline.STAGES:
        before = left
        left = corpus_pipeline.stage(step(spark, left, d), "test")
        seen.append(left.count())
        if name != "piece encoding":
            assert left.schema.names == docs.schema.names
            assert left.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
    assert docs.count() > seen[0] > seen[1] >= seen[2] > seen[3] == seen[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns and empty tables, against what each stage must do by hand."""
    text = "the quick brown fox jumps over the lazy dog while seven wizards brew ample potions near the quiet river bank at dawn"
    more = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, more), (5, more + " end"), (6, "a scoundrel. " * 3), (7, "plain words here"), (8, "x y z " * 50_000)]
    columns = "doc_id long, text string"
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 1) for r in rows], columns + ", lang string, source string, n_chars long, label int")
    labels = [(100 + i, int(i % 2 == 0)) for i in range(200)]
    teach = spark.createDataFrame([(i, f"{'a scoundrel' if y else 'a friend'} said word{i}.", "en", "s", 9, 1) for i, y in labels], docs.schema)
    docs.unionByName(teach).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "seven wizards brew ample potions near the quiet river bank"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id is None or r.doc_id < 100}
    # 1 and 2 hold an item, 3 is a copy of 4, the document without an id a near copy of 5, and 6 is toxic.
    assert left == {4, 5, 7, 8}
    empty = corpus_pipeline.STAGES[0][1](spark, docs.limit(0), str(tmp_path))
    for _, step in corpus_pipeline.STAGES[1:]:
        empty = step(spark, empty, str(tmp_path))
    assert empty.count() == 0


@pytest.mark.parametrize("run", ["a", "-", "=", "ab", "▁", "\x01"])
def test_repeated_characters(vocabulary, run):
    """Ties of one word: the scores are those of all cuts, and work and memory grow with its length, not with the ties."""
    for times in range(1, 11):
        word = (run * times)[:10]
        scores = sorted((sum(vocabulary.score[p] for p in cut) for cut in all_cuts(pieces.MARK + word, vocabulary)), reverse=True)[:4] if run != "▁" else None
        _, score, others = next(pieces.Encoder(vocabulary, 4).encode([word]))
        if scores is not None:
            found = [score, *[s for s, _ in others]]
            assert found == pytest.approx(scores)
    long = pieces.Encoder(vocabulary, 4)
    ids, score, others = next(long.encode([run * (300_000 // len(run))]))
    assert pieces.decode(np.frombuffer(ids, "<i4").tolist(), pieces.spellings(vocabulary)) == run * (300_000 // len(run))
    assert len(others) <= 3 and all(s <= score for s, _ in others)


def noisy_or(theta, bags, n, weight, ridge):
    """The penalised log-likelihood, bag by bag."""
    total = -0.5 * ridge * (theta[:-1] ** 2).sum()
    for (y, each, others), w in zip(bags, weight, strict=True):
        quiet = others * np.log1p(-1 / (1 + np.exp(-theta[-1])))
        quiet += sum(np.log1p(-1 / (1 + np.exp(-(theta[-1] + sum(theta[f] for f in s))))) for s in each)
        total += w * (np.log(-np.expm1(quiet)) if y else quiet)
    return total


def test_noisy_or_gradient():
    """Where the ascent ends, differences in every direction are flat: its gradient is that of the likelihood."""
    rng = np.random.default_rng(3)
    bags = [(int(rng.random() < 0.5), [sorted(rng.choice(4, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(1, 4))], int(rng.integers(0, 3))) for _ in range(40)]
    y = np.array([b[0] for b in bags])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y) * 0.5 + 0.5
    bias, weights = toxicity.fit(bags, 4, steps=6000, ridge=0.02)
    theta = np.append(weights, bias)
    best = noisy_or(theta, bags, 4, weight, 0.02)
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-4
        slope = (noisy_or(theta + step, bags, 4, weight, 0.02) - noisy_or(theta - step, bags, 4, weight, 0.02)) / 2e-4
        far = np.zeros(5)
        far[k] = 0.3
        assert abs(slope) < 0.05 and noisy_or(theta + far, bags, 4, weight, 0.02) < best and noisy_or(theta - far, bags, 4, weight, 0.02) < best


def test_toxicity_query_by_hand(spark, tmp_path):
    """The query's rows from its model sentence by sentence; held-out labels change nothing."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.op7_toxicity(spark, d).collect()}
    assert len(out) == docs.count()
    for r in docs.collect():
        none = 1.0
        for _, _, words in toxicity.sentences(r.text or ""):
            none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(w, 0.0) for w in words))))
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert out[r.doc_id].score == pytest.approx(1 - none, abs=1e-9) and out[r.doc_id].held_out == held and out[r.doc_id].predicted == (out[r.doc_id].score >= 0.3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: r.score for r in toxicity.op7_toxicity(spark, str(tmp_path)).collect()}
    assert again == pytest.approx({k: r.score for k, r in out.items()})
