"""Links that no leader shows: the exact search after the leaders' rounds."""

import random

import numpy as np

from tidewright.llm import near_dedup


def words(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(4, 10))) for _ in range(n)]


def labels_by_bands(spark, texts, bands, **options):
    """Label of each text, with given band keys instead of drawn ones."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sketched = near_dedup.written(near_dedup.sketch(docs), "test-sketch")
    row = {r.doc_id: r.row for r in sketched.filter("row is not null").collect()}
    signed = spark.createDataFrame([(row[i], b) for i, b in enumerate(bands)], "row long, bands array<long>")
    edges = near_dedup.links(sketched, signed, near_dedup.weights(sketched), **options)
    found = {r.row: r.label for r in near_dedup.components(edges).collect()}
    return [found.get(row[i], row[i]) for i in range(len(texts))]


def own_bands(i, shared=None):
    out = [1000 * (i + 1) + b for b in range(near_dedup.BANDS)]
    if shared is not None:
        out[0] = shared
    return out


def test_pair_under_an_unlike_leader(spark):
    rng = random.Random(5)
    passage, own = words(rng, 100), words(rng, 100)
    texts = [" ".join(passage + words(rng, 100)), " ".join(passage + own), " ".join(passage + own[:-10] + words(rng, 10)), " ".join(passage + words(rng, 100))]
    got = labels_by_bands(spark, texts, [own_bands(i, 7) for i in range(4)])
    assert got[1] == got[2] and len(set(got)) == 3


def test_prefix_join_finds_every_pair(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randrange(5, 150)) + ["of"] * rng.choice([0, 0, 30])
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randrange(0, 2)):
                text[rng.randrange(len(text))] = "edit%d" % rng.randrange(10**9)
            texts.append(" ".join(text + words(rng, rng.randrange(0, 4))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketched = near_dedup.written(near_dedup.sketch(docs), "test-sketch")
    weigh = near_dedup.weights(sketched)
    apart = sketched.filter("row is not null").selectExpr("row", "row AS cell", "1L AS size")
    got = {tuple(sorted((r.row, r.cell))) for r in near_dedup.visits(sketched, apart, weigh, 0.8).collect()}
    rows = [(r.row, near_dedup.unpack(r.ids), r.counts and np.frombuffer(r.counts, "<u4")) for r in sketched.filter("row is not null").orderBy("row").collect()]
    want = set()
    for k, (a, x, n) in enumerate(rows):
        for b, y, m in rows[k + 1 :]:
            if max(near_dedup.similarity(x, y, weigh(x, n), weigh(y, m))) >= 0.8:
                want.add((a, b))
    assert len(want) > 50 and want <= got


def test_pairs_inside_a_template_bucket(spark):
    rng = random.Random(4)
    template = words(rng, 160)
    texts = [" ".join(template + words(rng, 40)) for _ in range(60)]
    pairs = [(10, 51), (22, 45), (30, 41), (13, 37), (18, 33)]
    for i, j in pairs:
        near = template + words(rng, 40)
        texts[i], texts[j] = " ".join(near), " ".join(near[:-15] + words(rng, 15))
    got = labels_by_bands(spark, texts, [own_bands(i, 7) for i in range(60)])
    assert all(got[i] == got[j] for i, j in pairs)
    assert len(set(got)) == 55


def test_plain_copies_over_common_passages(spark):
    rng = random.Random(6)
    passages = [words(rng, 60) for _ in range(80)]
    texts = [" ".join(words(rng, 60)) for _ in range(160)]
    # A third of the documents hold all passages; each pair holds one, and differs in rare shingles only.
    texts += [" ".join(sum(passages, words(rng, 60))) + " " + " ".join(words(rng, 1800)) for _ in range(160)]
    texts += [" ".join(p + words(rng, 7)) for p in passages for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert all(got[k] == got[k + 1] for k in range(320, 480, 2))
    assert len(set(got.values())) == 400


def test_odd_sketches_bound_differences():
    rng = np.random.default_rng(2)
    for _ in range(200):
        both, a, b = (rng.choice(1 << 32, rng.integers(1, 900), replace=False).astype(np.uint32) for _ in range(3))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        least = near_dedup.apart_at_least(near_dedup.parity(x), near_dedup.parity(y))
        assert 0 <= least <= len(np.setxor1d(x, y))
    assert near_dedup.apart_at_least(near_dedup.parity(x), near_dedup.parity(x)) == 0


def test_likely_keeps_every_link(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(20):
        base = words(rng, rng.randrange(5, 120)) + ["of"] * rng.choice([0, 0, 30])
        texts += [" ".join(base + words(rng, rng.randrange(0, 60))) for _ in range(4)] + [" ".join(base + words(rng, 2)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketched = near_dedup.written(near_dedup.sketch(docs), "test-sketch")
    weigh = near_dedup.weights(sketched)
    rows = [r.row for r in sketched.filter("octet_length(ids) > 0").orderBy("row").collect()]
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]], "row long, leader long")
    kept = {tuple(r) for r in near_dedup.likely(sketched, pairs, weigh, 0.8).collect()}
    want = {(r.row, r.leader) for r in near_dedup.verify(sketched, pairs, weigh).collect() if r.likeness >= 0.8}
    assert len(want) >= 20 and want <= kept and len(kept) < pairs.count() / 3


def test_very_long_texts_and_weighted_links(spark):
    """Texts of 30,000 words; and a pair that only weights link: what differs stands in most documents."""
    rng = random.Random(12)
    long = words(rng, 30_000)
    near = list(long)
    for k in range(0, 30_000, 600):
        near[k] = "changed%d" % k
    common = [words(rng, 6) for _ in range(40)]
    texts = [" ".join(long), " ".join(near), " ".join(words(rng, 30_000))]
    texts += [" ".join(sum(common, [])) + " " + " ".join(words(rng, 30)) for _ in range(60)]
    rare = words(rng, 120)
    texts += [" ".join(rare), " ".join(rare + sum(common[:12], []))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got[0] == got[1] != got[2]
    plain = near_dedup.shingles(texts[-1].encode().split())
    assert len(near_dedup.shingles(texts[-2].encode().split())) / len(plain) < 0.8
    assert got[63] == got[64] and len(set(got.values())) == 63


def test_names_that_clash(spark):
    columns = "doc_id long, text string, row int, key string, label int, _tw_doc_id int"
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(2, text, 1, "k", 2, 3), (1, text, 1, "k", 2, 3), (None, text, 1, "k", 2, 3)], columns)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_packed_sets_and_texts_under_one_doc_id(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for n in (0, 1, 3000):
        ids = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        assert (near_dedup.unpack(near_dedup.pack(ids)) == ids).all()
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, text), (2, text), (2, other), (2, text), (3, None), (3, " ")], "doc_id long, text string").repartition(4)
    assert sorted(map(str, near_dedup.deduplicate(docs).collect())) == sorted(map(str, spark.createDataFrame([(1, text), (2, other), (3, None), (3, " ")], docs.schema).collect()))
    # Tables of many tasks add up in levels to the same counts.
    many = spark.createDataFrame([(k, f"{text} w{k % 7} x y z") for k in range(200)], docs.schema).repartition(23)
    monkeypatch.setattr(near_dedup, "FAN", 3)
    weigh = near_dedup.weights(near_dedup.written(near_dedup.sketch(many), "test-sketch"))
    assert weigh.documents == 200
    assert weigh.seen(near_dedup.shingles(text.encode().split())).tolist() == [200, 200, 200]
