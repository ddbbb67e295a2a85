"""The pipeline's stages on a table with planted cases, against brute force where it exists."""

import re

import corpus_pipeline
from test_near_quality import brute
from test_text_rules import spans

from tidewright.llm.word_tokens import END, word_encoder
from tidewright.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(100_000, "Token = abcdefgh here.", "en", "s", 22), (100_001, None, None, None, None), (100_002, "", "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS, name
    ids = [[r.doc_id for r in part] for part in kept[:4]]
    assert all(len(x) == len(set(x)) for x in ids)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in rows if labels.get(i) == 1]
    assert sum(i in set(ids[0]) for i in good) >= 0.97 * len(good)
    # Exact duplicates: one row of each text without white space.
    groups = {}
    for i in ids[0]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[i].text or ""), []).append(i)
    assert sorted(ids[1]) == sorted(min(own, key=lambda i: (-len(rows[i].text or ""), i)) for own in groups.values())
    # Near duplicates: no link may leave two rows.
    order = sorted(ids[1])
    _, pairs = brute([rows[i].text for i in order])
    stay = set(ids[2])
    assert not [1 for a, b in pairs if order[a] in stay and order[b] in stay]
    assert len(stay) >= len(set(brute([rows[i].text for i in order])[0])) * 0.98
    # Secrets are masked and nothing else changes.
    for r in kept[3]:
        before = rows[r.doc_id]
        found = spans(before.text)
        assert not spans(r.text)
        if not found:
            assert r == before
        else:
            assert r.text.count("[SECRET]") >= 1 and r.n_chars == len(r.text)
    assert sorted(ids[3]) == sorted(ids[2])
    # Packing holds every token of what is left.
    encode = word_encoder(vocabulary("word_bpe_49k.json"))
    total = sum(len(encode((r.text or "").encode()) + END) // 4 for r in kept[3])
    assert sum(r.length for r in kept[4]) == total


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name, query in QUERIES.items():
        assert query(spark, SF).columns, name
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
