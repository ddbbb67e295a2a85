"""One query per operator of this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import (
    byte_bpe,
    exact_dedup,
    fill_middle,
    hard_negatives,
    license_scan,
    near_dedup,
    packing,
    quality_model,
    quality_rules,
    secret_scan,
    simhash,
    token_store,
    warc,
)
from tidewright.llm.workspace import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.grown(table(spark, sf_dir, "documents")))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_store.digests(spark, path)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.scaled(table(spark, sf_dir, "embeddings"))
    mixed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", mixed), F.col("vec_id") % 100 == 0)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_license_scans,
        op3_secret_scans,
        op4_token_store,
        op5_minhash_near_dedup,
        op6_byte_bpe,
        op7_warc,
        op8_exact_dedup,
        op9_quality_classifier,
        op10_quality_rules,
        op11_hard_negatives,
        op12_fill_middle,
        op13_simhash_near_dedup,
    )
}

def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = lambda table: f"MAP([{', '.join(map(quoted, table))}], [{', '.join(map(quoted, table.values()))}])"
    known, text = license_scan.KNOWN, "lower(COALESCE(text, '') || chr(10))"
    for pattern, value in license_scan.STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(value)}, 'g')"
    hits = {
        name: "(" + " OR ".join(f"regexp_matches(seq, {quoted(';' + ';(?:[^;]+;)*'.join(steps) + ';')})" for steps in sequences) + ")"
        for name, sequences in license_scan.RULES.items()
    }
    rules = []
    for name in sorted(hits):
        stronger = "".join(f" AND NOT {hits[x]}" for x in license_scan.YIELDS.get(name, []))
        rules.append(f"CASE WHEN {hits[name]}{stronger} THEN {quoted(name)} END")
    return f"""WITH l AS (SELECT doc_id, '/ ' || {text} || ' /' AS line FROM documents),
  f AS (SELECT doc_id, list_transform(regexp_extract_all(line, {quoted(known.pattern)}), lambda s: trim(regexp_replace(s, '[|/ ]+', ' ', 'g'))) AS found FROM l),
  m AS (SELECT doc_id, found, {pairs(known.whole)} AS whole, {pairs(known.named)} AS named FROM f),
  i AS (SELECT doc_id, list_filter(flatten(list_transform(found, lambda s: CASE WHEN whole[s] IS NOT NULL THEN [whole[s]] WHEN regexp_matches(s, '^{license_scan.NEGATED} ') THEN []
  ELSE list_transform(regexp_extract_all(s, {quoted(known.name_pattern)}), lambda x: named[x]) END)), lambda x: x IS NOT NULL) AS ids FROM m),
  q AS (SELECT doc_id, ids, ';' || array_to_string(ids, ';') || ';' AS seq FROM i),
  r AS (SELECT doc_id, ids, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS found FROM q)
  SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, CAST(len(found) AS BIGINT) AS n_licenses, array_to_string(found, ',') AS licenses FROM r"""


ORACLE_SQL: dict[str, str] = {
    "op2_license_scans": _license_sql(),
    "op7_warc": """WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages), s AS (SELECT page_id, h, strlen(h) AS n, sha1(h) || '0' AS x FROM p),
  b AS (SELECT page_id, h, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((((strpos('0123456789abcdef', substr(x, 5 * i // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, 5 * i // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '') AS d FROM s),
  m AS (SELECT h, MAX(page_id) AS first FROM p GROUP BY h)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b JOIN m USING (h)""",
    "op8_exact_dedup": """WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_replace(COALESCE(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n FROM documents),
  k AS (SELECT n, COUNT(*) AS c, arg_min(doc_id, (-length(t), doc_id)) AS keep FROM d GROUP BY n)
  SELECT doc_id, keep AS keep_id, c AS group_size, doc_id = keep AS kept, sha256(n) AS text_sha256 FROM d JOIN k USING (n)""",
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
  SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""",
    "op12_fill_middle": """WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
  h AS (SELECT *, list_transform(range(4), lambda k: CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT)) AS h FROM d),
  c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
}
