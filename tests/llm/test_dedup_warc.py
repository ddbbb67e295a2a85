"""Exact deduplication and WARC archives against brute force."""

import base64
import gzip
import hashlib
import re
from bisect import bisect_right
from collections import defaultdict

import pytest

from tidewright.llm import exact_dedup, warc
from tidewright.llm.workspace import new_folder

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, group_size string").repartition(4)


def wanted(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    out = {}
    for text, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        for r in own:
            out[r[0]] = (keep, len(own), r[0] == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def sample(spark):
    return [(r.doc_id, r.text, r.source, r.n_chars, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


ODD = ["a b", "ab", "a\tb\n", "a\xa0b", "é b", "éb", "", None, " \r\n", "x" * 200_000, "x " * 200_000, *["copy of a text"] * 90, "a\x1cb", "a b", "ab "]


@pytest.mark.parametrize("bits", [64, 3, 1])
@pytest.mark.parametrize("whole", [False, True])
def test_groups(spark, bits, whole):
    rows = sample(spark) if whole else [(i, t, None, 1, "y") for i, t in enumerate(ODD)]
    got = exact_dedup.groups(frame(spark, rows), bits).collect()
    assert len(got) == len(rows)
    want = wanted(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == want[r.doc_id]
    kept = exact_dedup.deduplicate(frame(spark, rows), bits)
    assert kept.columns == ["doc_id", "text", "source", "n_chars", "group_size"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in want.items() if v[2])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "t", "a", 1, ""), (1, "t", "a", 1, ""), (None, "t", "a", 1, ""), (None, "u", "a", 1, "")]
    got = exact_dedup.groups(frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 4
    assert {r.keep_id for r in got if r.doc_id == 1} == {1}
    assert exact_dedup.deduplicate(frame(spark, rows)).count() == 2


def test_nothing(spark):
    none = frame(spark, [(1, "t", "a", 1, "")]).limit(0)
    assert exact_dedup.groups(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0


def test_directory_covers_the_key_space(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) _tw_key", "10L _tw_bytes")
    leaves = sorted((r.prefix << (48 - r.depth), r.depth) for r in exact_dedup.directory(rows, 400).collect())
    # Buckets follow one another, and each key lies in one.
    assert all(a + (1 << (48 - d)) <= b for (a, d), (b, _) in zip(leaves, leaves[1:]))
    firsts, sizes = [a for a, _ in leaves], defaultdict(int)
    for r in rows.collect():
        key = (r._tw_key % (1 << 64)) >> 16
        at = bisect_right(firsts, key) - 1
        assert key < leaves[at][0] + (1 << (48 - leaves[at][1]))
        sizes[at] += 10
    assert max(sizes.values()) <= 400 and len(leaves) > 100
    # One key over the capacity stays one bucket, and keys that share many bits end at the last depth.
    hot = rows.union(spark.range(3000).selectExpr("5L _tw_key", "10L _tw_bytes")).union(spark.range(100).selectExpr("(1L << 62) + id _tw_key", "10L _tw_bytes"))
    deep = {r.prefix << (48 - r.depth): r.depth for r in exact_dedup.directory(hot, 400).collect()}
    assert deep[1 << 46] == 48 and 0 in deep


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


HTML = ["<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n", "", None, "<p>a</p>", "long " * 50_000, "\r\n\r\n", "Content-Length: 5\r\n\r\n", "long " * 50_000, "\n"]


@pytest.mark.parametrize("least", [0, 10])
@pytest.mark.parametrize("whole", [False, True])
def test_archives(spark, least, whole):
    if whole:
        rows = [(r.page_id, r.url, r.html, "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
        rows += [(r[0] + 10_000, r[1], r[2], "") for r in rows[::5]]
    else:
        rows = [(i * 7, None if i == 3 else f"http://x/{i}\r\nInjected: 1", h, "") for i, h in enumerate(HTML)]
    path = new_folder(spark, "warc-test")
    warc.write(pages(spark, rows), path, least, file_bytes=2000)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    largest = {}
    for page, _, html, _ in rows:
        largest[html or ""] = max(page, largest.get(html or "", page))
    for page, _, html, _ in rows:
        data = (html or "").encode()
        first = largest[html or ""]
        revisit = page != first and len(data) >= least
        r = got[page]
        assert r.payload_bytes == len(data) and r.intact
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


def test_archive_of_nothing_nulls_and_repeats(spark):
    path = new_folder(spark, "warc-test")
    warc.write(pages(spark, [(1, "u", "h", "")]).limit(0), path)
    assert warc.read(spark, path).count() == 0
    path = new_folder(spark, "warc-test")
    warc.write(pages(spark, [(1, "u", "h", ""), (1, "u", "h", ""), (None, None, None, None), (0, "u", "h", "")]), path)
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read(spark, path).collect())
    assert got == [("0", "revisit", 1), ("1", "response", None), ("1", "response", None), ("None", "response", None)]


def test_archives_roll_by_bytes(spark, tmp_path):
    """Each file has one warcinfo record, first, and outgrows the limit by one record at most; a third of all pages are alike."""
    html = ["x%d " % i * 300 if i % 3 else "<b>alike</b>" * 40 for i in range(300)]
    path = str(tmp_path / "rolled")
    warc.write(pages(spark, [(i, "u", h, "") for i, h in enumerate(html)]), path, file_bytes=20_000)
    files = list((tmp_path / "rolled").rglob("*.gz"))
    assert len(files) > 10
    for file in files:
        data = file.read_bytes()
        kinds = [h["warc-type"] for h, _ in warc.parse(data)]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
        assert len(gzip.decompress(data)) < 20_000 + 3000
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == 300 and all(r.intact for r in got.values())
    assert sum(r.refers_to == 297 for r in got.values()) == 99


def test_parse_members_and_faults():
    text = warc.record(7, "http://x", "body " * 400_000, "D", 2_000_000, 7, None, "2024-01-01T00:00:00Z", False).encode() + b"\r\n\r\n"
    for data in (text * 3, gzip.compress(text) * 3, gzip.compress(text * 3)):
        found = list(warc.parse(data))
        assert [h["warc-record-id"] for h, _ in found] == ["<urn:x-page:7>"] * 3
        assert all(block.endswith(b"body ") for _, block in found)
    assert list(warc.parse(b"")) == []
    for broken in (text[:-4], text[:50], b"no record\r\n\r\n", text[:-4] + b"more"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_ids_and_names_that_clash(spark):
    least = -(1 << 63)
    rows = [(least, "t", 1, 2, 3), (5, "t", 1, 2, 3), (None, "t", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tw_row int, _tw_key int, own int")
    assert {r.keep_id for r in exact_dedup.groups(docs).collect()} == {least}
    assert [tuple(r) for r in exact_dedup.deduplicate(docs).collect()] == [rows[0]]
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    plain = docs.select("doc_id", "text")
    assert exact_dedup.deduplicate(plain).collect() == plain.limit(1).collect()


def test_owners_have_key_ranges(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2000) AS text")
    _, pages_ = exact_dedup.index(docs, owner_bytes=2000, bucket_bytes=500)
    spans = [(r.a, r.b) for r in pages_.groupBy("_tw_bucket").agg({"_tw_key": "min"}).selectExpr("_tw_bucket", "`min(_tw_key)` a").join(pages_.groupBy("_tw_bucket").agg({"_tw_key": "max"}).selectExpr("_tw_bucket", "`max(_tw_key)` b"), "_tw_bucket").collect()]
    unsigned = sorted((a % (1 << 64), b % (1 << 64)) for a, b in spans if a < 0 or b >= 0 and a >= 0)
    assert len(spans) > 20 and all(b < c for (_, b), (c, _) in zip(unsigned, unsigned[1:]))
    assert sum(r.kept for r in exact_dedup.groups(docs).collect()) == 2000
