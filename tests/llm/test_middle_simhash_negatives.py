"""Fill-in-the-middle, SimHash links and hard negatives against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import fill_middle, hard_negatives, simhash

NAMES = "doc_id long, text string"


def formed(doc_id, text):
    """What the fill-in-the-middle contract says of one row."""
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return f"<S>{suf}<P>{pre}<M>{mid}", "spm", n, a, b - a
    return f"<P>{pre}<S>{suf}<M>{mid}", "psm", n, a, b - a


def test_fill_middle_rows(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab <>PSM\né\U0001f926") for _ in range(rng.choice([0, 1, 2, 7, 300, 9000])))) for k in range(120)]
    rows += [(None, "no id"), (7, "again"), (7, "again"), (500, None), (501, ""), (502, "x" * 400_000), (503, "a <M> b"), (504, "<"), (505, "\x00\n")]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], NAMES + ", fim_form string, n int")
    out = fill_middle.transform(docs)
    assert set(out.columns) == {"doc_id", "text", "n", "fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars"}
    got = sorted(((r.doc_id, r.text, r.fim_form, r.fim_units, r.fim_prefix_chars, r.fim_middle_chars) for r in out.collect()), key=repr)
    assert got == sorted(((i, *formed(i, t)) for i, t in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    back = sorted(((r.doc_id, r.text) for r in fill_middle.restore(out).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((i, n, f, p, m, sha(o), sha(t or "")) for i, t in rows for o, f, n, p, m in [formed(i, t)]), key=repr)
    assert sorted((tuple(r) for r in fill_middle.digests(docs).collect()), key=repr) == want
    assert fill_middle.digests(docs.limit(0)).collect() == []


def test_rope_splits_at_unit_ranks():
    rng = random.Random(5)
    for pattern in (None, r"\S+\s*", r"[^\n]*\n|[^\n]+"):
        unit = re.compile(pattern, re.S) if pattern else None
        for size in (0, 1, 40, 3000):
            text = "".join(rng.choice("ab \né") for _ in range(size))
            own = fill_middle.rope(text, unit, leaf=16)
            assert str(own) == text and own.chars == size
            units = list(text) if unit is None else unit.findall(text)
            if unit and units and not text.startswith(units[0]):
                units[0] = text[: text.index(units[0]) + len(units[0])]
            assert own.units == len(units)
            for rank in {0, 1, len(units) // 3, len(units), len(units) + 4}:
                a, b = fill_middle.split(own, rank)
                assert str(a) == "".join(units[:rank]) and str(b) == "".join(units[rank:])
                assert (a.units, a.chars) == (len(units[:rank]), len(str(a)))
        former = fill_middle.Former(pattern, fim=100, seed=9)
        for k in range(30):
            text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(5000)))
            assert former.restore(*former(k, text)[:2]) == text
    with pytest.raises(ValueError):
        fill_middle.Former(sentinels=("<P>", "<P><", "<M>"))
    with pytest.raises(ValueError):
        fill_middle.Former(sentinels=("ab", "bc", "x"))
    with pytest.raises(ValueError):
        fill_middle.Former().restore("no output", "psm")


def test_bytes_that_are_no_text_come_back(spark):
    docs = spark.createDataFrame([(k, bytes([0x61, 0xFF, 0x62, 0xC3])) for k in range(20)], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = fill_middle.restore(fill_middle.transform(docs)).select(F.hex(F.col("text").cast("binary"))).distinct().collect()
    assert [r[0] for r in got] == ["61FF62C3"]


def printed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints):
    """Component of each distinct fingerprint by all pairs."""
    left, label = set(prints), {}
    while left:
        todo = [start := min(left)]
        left.discard(start)
        while todo:
            x = todo.pop()
            label[x] = start
            near = [y for y in left if (x ^ y).bit_count() <= 2]
            left.difference_update(near)
            todo += near
    return label


def test_simhash_rows(spark):
    rng = random.Random(11)
    words = ["w%d" % k for k in range(50)] + ["Été", "MiXed", "tab s"]
    rows = []
    for k in range(150):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))]
        for _ in range(rng.randrange(1, 4)):
            text = list(base)
            if text and rng.random() < 0.6:
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((rng.randrange(10_000), rng.choice([" ", "\n", "\t\x0b "]).join(text)))
    rows += [(None, rows[0][1]), (20_000, None), (20_001, " \n"), (20_002, "w1 " * 40_000), (20_002, "A b"), (20_003, "a B")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], NAMES + ", print int, label string")
    label = reachable([printed(t) for _, t in rows])
    least = {}
    for i, t in rows:
        own = label[printed(t)]
        if i is not None:
            least[own] = min(least.get(own, i), i)
    want = sorted(((i, f"{printed(t):016x}", least.get(label[printed(t)])) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in simhash.groups(docs).collect()), key=repr) == want
    assert simhash.groups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("share", [simhash.SHARE, 3])
def test_simhash_links_in_crowded_buckets(spark, share, monkeypatch):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(300)}
    # Over LIMIT fingerprints with 32, then 48 bits in common; chains of one and two bits; pairs at three.
    for shift, mask in ((32, 0xFFFFFFFF), (16, 0xFFFF)):
        base = rng.getrandbits(64)
        prints |= {base ^ (rng.getrandbits(64) & mask) << (shift % 32) for _ in range(400)}
    for x in list(prints)[:200]:
        for bits in (1, 2, 3):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            prints.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(x,) for x in signed], "print long")
    with simhash.Scratch(spark):
        edges = [(r.row, r.leader) for r in simhash.links(table, share).collect()]
    whole = lambda x: x % (1 << 64)
    label = reachable(prints)
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert label[whole(a)] == label[whole(b)]
        parent[find(whole(a))] = find(whole(b))
    assert len({find(x) for x in prints}) == len(set(label.values()))


def test_masks_leave_two_blocks_for_any_two_bits():
    first = simhash.masks()[0]
    assert {bin(m).count("1") for m in first} == {32} and {bin(m).count("1") for m in simhash.masks()[-1]} == {56}
    for a in range(64):
        for b in range(64):
            assert any(not (m >> a & 1 or m >> b & 1) for m in first)


def mined(rows, every=100, k=5, n=10):
    """Hard negatives by all scores; rows: vec_id, vector, label after relabelling."""
    out = []
    for i, v, y in rows:
        if i % every:
            continue
        others = sorted(((-int(np.dot(v, w)), j, z) for r, (j, w, z) in enumerate(rows) if w is not v), key=lambda x: x[:2])
        for score, j, _ in [x for x in others if x[2] == y][:k]:
            fits = [(j2, -s) for s, j2, z in others if z != y and 30 * -score <= 100 * -s <= 90 * -score][:n]
            out += [(i, j, rank, m, -score, s) for rank, (m, s) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("levels", [0, 3])
def test_hard_negatives(spark, levels, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + 0.4 * rng.normal(size=8)).astype("f4").tolist(), int(rng.integers(4))) for i in range(900)]
    # A crowd of equal vectors (ties), short, empty and zero vectors, repeats.
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(200)] + [(1300, [1.0], 1), (1301, [], 2), (1400, [0.0] * 8, 0), (1500, [-9.0] * 8, 1), rows[3], rows[200]]
    bad = [(None, [1.0] * 8, 1), (1600, None, 1), (1700, [1.0] * 8, None), (1800, [1.0, None], 1), (1900, [float("nan")] * 8, 1), (2000, [float("inf")] * 8, 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, label int, anchor string, row int")
    vectors = hard_negatives.scaled(table)
    got = hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, levels=levels, block=150)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    whole = [(i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v))), y) for i, v, y in rows]
    assert sorted(map(tuple, got.collect())) == mined(whole)
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    huge = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        hard_negatives.mine(hard_negatives.scaled(huge), F.col("vec_id") % 100 == 0)


def test_traversal_leaves_out_what_lies_outside_the_annulus():
    rng = np.random.default_rng(8)
    centres = 1000 * rng.normal(size=(8, 6))
    vectors = np.floor(np.repeat(centres, 64, axis=0) + rng.normal(size=(512, 6)))
    space = hard_negatives.Space(float((vectors**2).sum(axis=1).max()), 6, False)
    tree = hard_negatives.Tree(vectors, space, leaf=16)
    touched = []

    class Counted(hard_negatives.Asked):
        def add(self, scores, ids):
            touched.append(len(scores))
            super().add(scores, ids)

    anchor = vectors[5]
    scores = vectors @ anchor
    state = Counted([{"w": 1, "lo": -hard_negatives.FAR, "hi": hard_negatives.FAR}], 4)
    hard_negatives.nearest(tree, anchor, space.reach(anchor[None, :], tree.points)[0], state, np.ones(512, bool), tree.order)
    best = np.lexsort((np.arange(512), -scores))[:4]
    assert state.found[0][1].tolist() == best.tolist()
    assert len(touched) < 16
