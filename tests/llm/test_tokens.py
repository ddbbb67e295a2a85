"""Encoders against the tokenizers library, the ORC files and the packing."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.llm import byte_bpe as bpe_module
from tidewright.llm import packing, token_store
from tidewright.llm.byte_bpe import byte_bpe, round_trip
from tidewright.llm.word_tokens import END, WordEncoder, word_encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ALPHABETS = [
    "ab e",
    "aAeE'sStT dDlL",
    "the an in er 0123456789.,!?#$\n",
    "".join(map(chr, range(0x20, 0x7F))) + "\t\n\r\x0b\x0c",
    "".join(map(chr, range(0x00, 0x250))),
    "é́ßΣσςİıñ ﬁ½²  　​ 漢字かな한글😀👩‍🚀",
]


def random_texts(n=400):
    rng = random.Random(5)
    out = ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaa", "don't DON'T", "  \n x"]
    for k in range(n):
        alphabet = ALPHABETS[k % len(ALPHABETS)]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))
        out.append(text if k % 7 else text + "<|endoftext|>" + text)
    return out


def sample(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_words_as_the_library():
    library, own = Tokenizer.from_file(WORDS), word_encoder(WORDS)
    for text in random_texts(1200):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own(text.encode()), "<u4").tolist() == want, repr(text)


def test_bytes_as_the_library():
    library, own = Tokenizer.from_file(BYTES), byte_bpe(BYTES)
    for text in random_texts(1200):
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got.tolist() == want, repr(text)
        assert own.decode(got) == library.decode(want, skip_special_tokens=False) == text
        assert own.decimal(got).decode() == ",".join(map(str, want))


@pytest.mark.parametrize("text", ["a" * 20_000, "abc" * 5000 + "é" * 3000, "=" * 9000 + "1" * 9000, "漢字" * 4000])
def test_one_long_pre_token(text):
    """Words that no memo keeps encode as the library does, twice over."""
    library, own, words = Tokenizer.from_file(BYTES), byte_bpe(BYTES), word_encoder(WORDS)
    want = library.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert own.encode(text).tolist() == want
        assert own.decode(np.array(want, np.uint32)) == text
        assert np.frombuffer(words(text.encode()), "<u4").tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_broken_utf8_decodes_as_the_library():
    library, own = Tokenizer.from_file(BYTES), byte_bpe(BYTES)
    rng = random.Random(7)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(0, 9))]
        assert own.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_real_words_as_the_library(spark):
    library, own = Tokenizer.from_file(BYTES), byte_bpe(BYTES)
    words, word = Tokenizer.from_file(WORDS), word_encoder(WORDS)
    for text in sample(spark):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(word(text.encode()), "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i * 3 + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(3)


def test_round_trip_rows(spark):
    library = Tokenizer.from_file(BYTES)
    texts = [None, *random_texts(60)]
    got = {r.doc_id: r for r in round_trip(frame(spark, texts), BYTES).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[i * 3 + 1]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert round_trip(frame(spark, texts).limit(0), BYTES).count() == 0


def test_store_round_trip_and_pruning(spark, tmp_path):
    library = Tokenizer.from_file(WORDS)
    texts = [None, *sample(spark)]
    path = str(tmp_path / "tokens")
    token_store.write_tokens(frame(spark, texts), path, WORDS)
    got = {r.doc_id: r for r in token_store.digests(spark, path).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[i * 3 + 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = token_store.read_tokens(spark, path, [4, 7])
    assert sorted(r.doc_id for r in rows.collect()) == [4, 7]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_memo_of_pieces_is_bounded():
    """Rare pieces go, common ones come back from the older half, long ones are not kept; ids stay the library's."""
    library, own, rng = Tokenizer.from_file(WORDS), WordEncoder(WORDS, pieces=500), random.Random(8)
    for k in range(12):
        words = ["".join(rng.choice("etaoinshrdlué") for _ in range(9)) for _ in range(300)] + ["the", "don't"] * 20 + ["ab" * 200, "=" * 300]
        rng.shuffle(words)
        text = " ".join(words)
        assert np.frombuffer(own(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        kept = [*own._pieces, *own._older]
        assert "the" in own._pieces and len(kept) < 2000
        assert max(map(len, kept)) < 200


def test_store_sends_small_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "seen").mkdir()
    plain, seen = token_store.texts, str(tmp_path / "seen")

    def noted(batches):
        def each():
            for at, batch in enumerate(batches):
                open(f"{seen}/{at}-{batch.nbytes}", "w").close()
                yield batch

        return plain(each())

    monkeypatch.setattr(token_store, "texts", noted)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 300) AS text").coalesce(1)
    token_store.write_tokens(docs, str(tmp_path / "tokens"), WORDS)
    sizes = [int(p.name.split("-")[1]) for p in (tmp_path / "seen").iterdir()]
    assert sizes and max(sizes) < 3 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b")
    rows = token_store.digests(spark, str(tmp_path / "tokens")).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in rows) == [(i, i * 601, 601) for i in range(4000)]
    assert len({r.ids_crc32 for r in rows}) == 1


def test_store_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_store.write_tokens(frame(spark, ["x"]).limit(0), path, WORDS)
    assert token_store.digests(spark, path).count() == 0


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= capacity.tokens
        assert len(own) <= (capacity.documents or 1e9)
        assert sum(x * x for _, x in own) <= (capacity.cost or 1e18)
    return len(bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(512, 3), packing.Capacity(512, 4, 90_000.0)])
def test_packing(spark, score, capacity):
    encode = word_encoder(WORDS)
    texts = [None, "", *sample(spark), *(["again and again"] * 50)]
    if capacity.cost:
        texts = [t for t in texts if len(encode((t or "").encode())) // 4 < 290]
    rows = packing.pack(frame(spark, texts), WORDS, capacity, score=score).collect()
    bins = check_places(rows, capacity)
    total = 0
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.piece] = r
    for i, text in enumerate(texts):
        data = encode((text or "").encode()) + END
        own = got[i * 3 + 1]
        assert sorted(own) == list(range(len(own)))
        for k, r in own.items():
            part = data[4 * r.start : 4 * (r.start + r.length)]
            assert r.start == k * capacity.tokens and r.ids_crc32 == zlib.crc32(part) and len(part) == 4 * r.length
        assert sum(r.length for r in own.values()) == len(data) // 4
        total += len(data) // 4
    if capacity == packing.Capacity() and score == "norm":
        assert bins <= -(-total // capacity.tokens) + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(100, 5), packing.Capacity(100), packing.Capacity(100, 7, 4000.0)])
def test_packing_against_one_by_one(score, capacity):
    """Runs of bins give what placing the pieces one at a time gives, by the vector score."""
    rng = random.Random(3)
    weights = (1.0, 0.0537, 0.0711)
    scale = np.array(weights) / capacity.vector()
    for _ in range(30):
        longest = rng.choice([20, 60])
        lengths = [rng.randrange(1, longest) for _ in range(rng.randrange(1, 400))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.best_fit(counts, capacity, weights, score)
        rooms, held = [], []
        for x in sorted(lengths, reverse=True):
            need = np.array([x, 1.0, x * x])
            fits = [i for i, room in enumerate(rooms) if (room >= need).all()]
            if not fits:
                rooms.append(capacity.vector())
                held.append([])
                best = len(rooms) - 1
            elif score == "dot":
                best = max(fits, key=lambda i: ((rooms[i] * scale) @ (need * scale), -i))
            else:
                best = min(fits, key=lambda i: ((((rooms[i] - need) * scale) ** 2).sum(), i))
            rooms[best] = rooms[best] - need
            held[best].append(x)
        assert plan.bins == len(rooms)
        pieces = [(n, k) for n, c in counts.items() for k in range(c)]
        at, offset = plan.place(*(np.array(x, dtype=np.int64) for x in zip(*pieces)))
        got = defaultdict(list)
        for bin_, (n, _) in zip(at.tolist(), pieces):
            got[bin_].append(n)
        # Bins of equal residuals are alike to the score, whatever they hold.
        used = lambda bins: sorted((sum(x), len(x), sum(n * n for n in x)) for x in bins)
        assert used(got.values()) == used(held)


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, ["x"]).limit(0), WORDS).count() == 0


def test_too_costly_piece_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit({10: 1}, packing.Capacity(20, None, 50.0))


def test_windows_of_matches_do_not_show_in_ids(monkeypatch):
    own, rng = bpe_module.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    texts = ["".join(rng.choice("abcdefgh theinorsté中") for _ in range(n)).replace(" ", "") for n in (1, 40, 900, 6000)] + ["a" * 5000, "ab" * 3000]
    whole = [list(own.cut(x.encode())) for x in texts]
    assert all(own.decode(np.array(ids, np.uint32)) == x for ids, x in zip(whole, texts))
    for window in (3, 64):
        monkeypatch.setattr(bpe_module, "WINDOW", window)
        assert [list(own.cut(x.encode())) for x in texts] == whole


def test_one_pre_token_of_megabytes_needs_little_memory():
    import tracemalloc

    own, rng = bpe_module.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    data = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20)).encode()
    own.cut(data[: 1 << 16])  # fills the memo of pairs
    tracemalloc.start()
    ids = own.cut(data)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert own.decode(np.frombuffer(ids, np.uint32)).encode() == data
    assert most < 60 << 20
