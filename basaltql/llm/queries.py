"""The opN queries: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import brown_lm, decontaminate, ecoc_langid, feistel_pii, flac_media, ipf_mix, kneser_ney, simhash_vptree, toxic_fst
from .common import crc_mod, table
from .suffix_dedup import kept_digest, suffix_dedup


#: For checks and tests only; a session that pseudonymises real data sets spark.basaltql.pii.key.
PII_KEY = "a key for checks, not a secret"


def op1_suffix_dedup(spark, sf_dir):
    return kept_digest(suffix_dedup(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_kneser_ney(spark, sf_dir):
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op4_brown_lm(spark, sf_dir):
    return brown_lm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) != 0)


def op5_simhash_vptree(spark, sf_dir):
    return simhash_vptree.digest(simhash_vptree.near_duplicates(table(spark, sf_dir, "documents")))


def op6_ecoc_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = ecoc_langid.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return ecoc_langid.identify(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)


def op7_toxic_fst(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxic_fst.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return toxic_fst.toxicity(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


def op8_feistel_pii(spark, sf_dir):
    return feistel_pii.pseudonymize(table(spark, sf_dir, "documents"), feistel_pii.session_key(spark, PII_KEY)).select("doc_id", "text", "n_found")


def op10_ipf_mix(spark, sf_dir):
    mixed = ipf_mix.mixed(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "sampled")


def op9_flac_media(spark, sf_dir):
    return flac_media.features(flac_media.encode(table(spark, sf_dir, "documents")))


def lm_base_scores(spark, sf_dir):
    """What op4 counts, and its base score: the part that SQL can express."""
    return op4_brown_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def media_payloads(spark, sf_dir):
    """What op9 reads back from its streams, without the streams' own bytes and features."""
    return op9_flac_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def media_blocks(spark, sf_dir):
    """The PCM blocks of all texts' streams, by sample offset."""
    docs = table(spark, sf_dir, "documents")
    blocks = flac_media.decode(flac_media.encode(docs))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.min("sample_offset").alias("first_sample"), F.max("sample_offset").alias("last_sample"))


def langid_split(spark, sf_dir):
    """Which rows op6 holds out, and which it calls und."""
    return op6_ecoc_langid(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("und"))


def exact_leaks(spark, sf_dir):
    """The hits of op2 without an edit."""
    return op2_decontaminate(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def _crc32(bytes_list: str) -> str:
    """DuckDB SQL of the CRC-32 of a list of byte values."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda c, x: {_crc_step()}), 4294967295::BIGINT)"


def _crc_step() -> str:
    """One byte of a CRC-32: eight shifts, spelled out over lists of one value."""
    step = "[xor(c, x)]"
    for _ in range(8):
        step = f"list_transform({step}, lambda v: xor(v >> 1, 3988292384::BIGINT * (v & 1)))"
    return f"({step})[1]"


_ID_CRC = _crc32("list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda e: CAST(ascii(e) AS BIGINT))")
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = "trim(regexp_replace(lower(coalesce(text, '')), '[\\s\\x{85}\\x{A0}\\x{1C}-\\x{1F}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_brown_lm": op4_brown_lm,
    "op5_simhash_vptree": op5_simhash_vptree,
    "op6_ecoc_langid": op6_ecoc_langid,
    "op7_toxic_fst": op7_toxic_fst,
    "op8_feistel_pii": op8_feistel_pii,
    "op9_flac_media": op9_flac_media,
    "op10_ipf_mix": op10_ipf_mix,
    "lm_base_scores": lm_base_scores,
    "media_payloads": media_payloads,
    "media_blocks": media_blocks,
    "langid_split": langid_split,
    "exact_leaks": exact_leaks,
}

ORACLE_SQL = {
    "lm_base_scores": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ID_CRC} % 10 = 0 AS held_out,
             list_append(regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+'), ' ') AS ws FROM documents),
w AS (SELECT r, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
t AS (SELECT sum(c) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(c.w) AS k, sum(log10((coalesce(c.c, 0) + 0.1) / (t.n + 0.1 * (t.v + 1)))) AS b FROM w LEFT JOIN c USING (w), t GROUP BY r)
SELECT doc_id, held_out, CAST(len(ws) AS BIGINT) AS n_tokens, k AS n_known, CAST(t.n AS BIGINT) AS train_tokens, round(b, 4) AS base_score FROM d JOIN s USING (r), t
""",
    "media_payloads": f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, hex(b) || repeat('20', greatest(192, CAST(ceil(octet_length(b) / 192) AS INT) * 192) - octet_length(b)) AS h FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(length(h) // 2 AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
       {_crc32("list_transform(range(16), lambda i: CAST('0x' || substr(h, length(h) - 31 + 2 * CAST(i AS INT), 2) AS BIGINT))")} AS tail_crc32 FROM p
""",
    "media_blocks": """
SELECT doc_id, CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 192)) AS BIGINT) AS n_blocks, CAST(0 AS BIGINT) AS first_sample,
       CAST(192 * (greatest(1, ceil(strlen(coalesce(text, '')) / 192)) - 1) AS BIGINT) AS last_sample FROM documents
""",
    "langid_split": f"SELECT doc_id, {_ID_CRC} % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS und FROM documents",
    "exact_leaks": f"""
WITH i AS (SELECT item_id, {_NORMAL} AS t FROM benchmark), d AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
SELECT doc_id, item_id FROM d JOIN i ON i.t <> '' AND contains(d.t, i.t) AND (strlen(i.t) >= 8 OR contains(' ' || d.t || ' ', ' ' || i.t || ' '))
""",
    "op10_ipf_mix": ipf_mix.oracle_sql(),
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE m.least < w.doc_id),
isl AS (SELECT doc_id, p, CASE WHEN p <= max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hit),
grp AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM isl),
span AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM grp GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM span
        UNION ALL SELECT s.doc_id, max(s.b), any_value(length(d.h)) // 2 FROM span s JOIN d USING (doc_id) GROUP BY s.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
tot AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(t.c, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN t.n IS NULL THEN d.h ELSE coalesce(k.k, '') END)) AS kept_sha256
FROM d LEFT JOIN tot t USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
}
