"""Near-duplicate classes against brute force, and the quality classifier's accuracy."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewright.llm import near_dedup, quality_model

SF = "/root/testdata/sf0.01"


def frame(spark, texts, extra=0):
    return spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, row long, key string").repartition(5)


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    return out


def brute(texts, threshold=0.8):
    """Classes by all pairs that share a shingle."""
    sets, where = shingle_sets(texts), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = defaultdict(int)
    for own in where.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                shared[i, j] += 1
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    same = defaultdict(list)
    for i, t in enumerate(texts):
        if (t or "").split():
            same[tuple(t.split())].append(i)
    joined = [(own[0], j) for own in same.values() for j in own[1:]]
    joined += [(i, j) for (i, j), n in shared.items() if n >= threshold * (len(sets[i]) + len(sets[j]) - n)]
    for i, j in joined:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return [root(i) for i in range(len(texts))], joined


def words(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "edit%d" % rng.randrange(10**9)
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    passage = words(rng, 60)
    texts = [" ".join(passage + words(rng, 90)) for _ in range(300)]  # share a passage only
    base = words(rng, 300)
    texts += [" ".join(edited(rng, base, 3)) for _ in range(200)]  # one large group
    for _ in range(40):
        base = words(rng, rng.randrange(60, 200))
        texts += [" ".join(edited(rng, base, rng.randrange(1, 3))) for _ in range(rng.randrange(2, 5))]
    texts += [None, "", "  ", "one two", "one  two", "one two three", "a b c d e", "a b c d e", "of " * 50, "of " * 70]
    rng.shuffle(texts)
    return texts


def test_planted(spark, planted):
    want, pairs = brute(planted)
    got = {r.doc_id: r for r in near_dedup.classes(frame(spark, planted)).collect()}
    assert len(got) == len(planted)
    for i, j in pairs:
        assert got[i].class_id == got[j].class_id
    sizes = defaultdict(int)
    for i in range(len(planted)):
        sizes[got[i].class_id] += 1
        # Weights may join more, but not texts that share only a passage.
        if want.count(want[i]) == 1:
            assert got[i].class_size == 1, planted[i]
    for i in range(len(planted)):
        assert got[i].class_size == sizes[got[i].class_id] and got[i].kept == (i == got[i].class_id)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want, pairs = brute([r.text for r in rows])
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    lost = [(i, j) for i, j in pairs if got[rows[i].doc_id] != got[rows[j].doc_id]]
    assert not lost
    assert len(set(got.values())) >= 0.99 * len(set(want))


def test_near_nothing_and_nulls(spark):
    assert near_dedup.classes(frame(spark, ["x"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.class_id, r.class_size, r.kept) for r in near_dedup.classes(rows).collect())
    assert got == [("1", 1, 3, True), ("1", 1, 3, True), ("2", 2, 1, True), ("None", 1, 3, True)]
    assert near_dedup.deduplicate(rows).count() == 4


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(1)
    a = np.sort(rng.choice(1 << 32, 3000, replace=False)).astype(np.uint32)
    w = rng.uniform(0.5, 8, 3000).astype(np.float32)
    b, v = a[500:], w[500:] * np.float32(1.1)
    sample = near_dedup.Sampler(functions=600)
    same = (sample(a, w, np.array([0])) == sample(b, v, np.array([0]))).mean()
    want = near_dedup.similarity(a, b, w, v)[0]
    assert abs(same - want) < 0.07


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.report(docs, labels).collect()
    assert len(rows) == docs.count()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r.score for r in held if quality[r.doc_id] == 1]
    bad = [r.score for r in held if quality[r.doc_id] == 0]
    assert good and bad
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert auc > 0.97
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.95


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 5), quality_model.FEATURES)) for _ in range(40)]
    labels = np.array([int(b[:, 0].max() > 0.8) for b in bags])
    model = quality_model.fit(bags, labels, steps=300)
    x, starts = np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    assert ((model.score(x, starts) > 0.5) == labels).mean() > 0.95


def test_gradients_against_differences():
    """Every gradient equals the difference quotient of the loss."""
    rng = np.random.default_rng(1)
    x, starts, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0, 0.0])
    w = quality_model._initial(5, 4, 3, 0.6, 2)
    _, grad = quality_model.gradients(w, x, starts, y)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            losses = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                losses.append(quality_model.gradients(moved, x, starts, y)[0])
            assert abs((losses[0] - losses[1]) / 2e-6 - grad[name][at]) < 1e-6


def test_words_alone_tell():
    """Good and bad documents differ in a few words only, of the same letters and lengths, in one passage of several."""
    rng = random.Random(3)
    plain, good, bad = words(rng, 400), ["solid", "tests", "proof"], ["dilos", "sttes", "foorp"]
    texts, labels = [], []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(rng.randrange(80, 300))]
        at = rng.randrange(len(text) - 20)
        for k in range(at, at + 20, 2):
            text[k] = rng.choice(good if i % 2 else bad)
        texts.append(" ".join(text).encode())
        labels.append(i % 2)
    model = quality_model.fit([quality_model.bag(t) for t in texts[:450]], np.array(labels[:450]))
    right = 0
    for text, label in zip(texts[450:], labels[450:]):
        right += (model.score(quality_model.passages(text), np.array([0]))[0] > 0.5) == label
    assert right >= 0.9 * 150


def test_bags_cover_whole_texts():
    text = " ".join(f"w{k}" for k in range(64 * 200)).encode()
    whole, small = quality_model.passages(text), quality_model.bag(text)
    assert (len(whole), len(small)) == (200, quality_model.BAG)
    sizes = np.diff(np.append(np.arange(64) * 200 // 64, 200))
    assert np.allclose((small * sizes[:, None]).sum(axis=0), whole.sum(axis=0))


def test_quality_edge_cases(spark):
    docs = frame(spark, [None, "", "word", "long " * 60_000])
    labels = spark.createDataFrame([(0, None), (None, 1), (99, 1)], "doc_id long, quality int")
    assert [r.score for r in quality_model.report(docs, labels).collect()] == [0.5] * 4
    assert quality_model.report(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(k, 1) for k in range(4)], "doc_id long, quality int")
    assert [r.score for r in quality_model.report(docs, one).collect()] == [1.0] * 4
    some = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    got = quality_model.accepted(docs, some)
    assert got.columns == docs.columns
