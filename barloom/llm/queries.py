"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import ann, decontamination, mixing, ngram, pieces, pii, prefix_trie, quality, resampling, sharding, simhash, tokenfile, toxicity
from barloom.llm.common import table
from barloom.session import scratch


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/ids"
    tokenfile.write_ids(table(spark, sf_dir, "documents"), folder)
    return tokenfile.read_digests(spark, folder)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_pieces": op2_pieces,
    "op3_simhash": op3_simhash,
    "op4_ann": op4_ann,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_ngram": op7_ngram,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_tokenfile": op10_tokenfile,
    "op11_resampling": op11_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_decontamination": op13_decontamination,
}

#: CTE `crc`: the table of the reflected CRC-32 polynomial, made by its rule; and the checksum of the bytes whose hex digits are in `x`.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""
_CRC_OF = """xor(list_reduce(list_prepend(4294967295, list_transform(range(length({x}) // 2), lambda i: CAST('0x' || substr({x}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"""
_WORDS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL of the same rows.
ORACLE: dict[str, str] = {
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM per),
levelled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER up_to, 0) AS DOUBLE) / CAST(sum(weight) OVER from_here AS DOUBLE) AS level,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS turn
  FROM weighed
  WINDOW up_to AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         from_here AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight <= cap THEN weight * first_value(level) OVER (ORDER BY (level * weight <= cap) DESC, turn) ELSE CAST(cap AS DOUBLE) END AS target
  FROM levelled),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, b.source_size, b.target,
       CAST(b.epochs * p.size + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.before)) AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
""",
    "op11_resampling": f"""
WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="text")} AS w FROM documents),
features AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[CAST(i AS BIGINT)] || ' ' || w[CAST(i + 1 AS BIGINT)]))) AS f FROM docs),
wanted AS (SELECT {_WORDS.format(t="text")} AS w FROM benchmark),
wanted_features AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[CAST(i AS BIGINT)] || ' ' || w[CAST(i + 1 AS BIGINT)]))) AS f FROM wanted),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM features UNION SELECT f FROM wanted_features)),
bucketed AS (SELECT f, {_CRC_OF.format(x="x")} % 10000 AS bucket FROM hexed, crc),
s AS (SELECT bucket, count(*) AS s FROM features JOIN bucketed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted_features JOIN bucketed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) AS DOUBLE)
         / CAST((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM features JOIN bucketed USING (f) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END END AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, (25 * count(*) OVER ()) // 100 AS taken
  FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN place <= taken THEN place END AS BIGINT) AS rank
FROM scored LEFT JOIN placed USING (r)
""",
    "op12_prefix_trie": f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id AS conv, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv, digest, bytes, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, digest) AS pos FROM turns),
hexed AS (SELECT conv, count(*) AS n, hex(encode(CAST(conv AS VARCHAR))) AS x FROM turns GROUP BY conv),
convs AS (SELECT conv, n, conv - conv % 5 AS base, {_CRC_OF.format(x="x")} % 9 AS h FROM hexed, crc),
sized AS (SELECT c.conv, c.n, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS m FROM convs c LEFT JOIN convs b ON b.conv = c.base),
rebuilt AS (
  SELECT s.conv, p.pos AS depth, p.digest, p.bytes FROM sized s JOIN placed p ON p.conv = s.base AND p.pos <= s.m
  UNION ALL
  SELECT s.conv, s.m + p.pos - s.h AS depth, p.digest, p.bytes FROM sized s JOIN placed p ON p.conv = s.conv AND p.pos > s.h),
keyed AS (SELECT conv, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv ORDER BY depth ROWS UNBOUNDED PRECEDING) AS k FROM rebuilt),
members AS (SELECT conv, depth, bytes, k FROM keyed UNION ALL SELECT conv, 0, 0, '' FROM sized),
lengths AS (SELECT conv, max(depth) AS depth FROM members GROUP BY conv),
nodes AS (SELECT k, min(conv) AS conv_id, max(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM members GROUP BY k),
kin AS (SELECT k[:-33] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kin USING (k)),
upwards AS (SELECT left(k, 32 * CAST(unnest(range(depth + 1)) AS BIGINT)) AS k, saved, n_children FROM full_nodes),
subtrees AS (SELECT k, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM upwards GROUP BY k),
ends AS (SELECT k, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) AS ids FROM members JOIN lengths USING (conv, depth) GROUP BY k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes n JOIN subtrees USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.k[:-33]
""",
    "op13_decontamination": f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format(t="text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, kind, array_to_string(w[CAST(i AS BIGINT):CAST(i + kind - 1 AS BIGINT)], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS kind, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="text")} AS w FROM documents),
runs AS (
  SELECT r, i, kind, array_to_string(w[CAST(i AS BIGINT):CAST(i + kind - 1 AS BIGINT)], ' ') AS win
  FROM (SELECT r, w, kind, unnest(range(1, len(w) - kind + 2)) AS i FROM docs, (SELECT DISTINCT kind FROM windows) WHERE len(w) >= kind)),
hits AS (SELECT r, i, kind, win FROM runs SEMI JOIN windows USING (kind, win)),
words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + kind)) AS place FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM hits JOIN windows USING (kind, win)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
""",
}
