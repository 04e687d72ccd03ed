"""The thin ``opN_<name>`` queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerotally.llm import bit_sliced_topk, divergence_audit, host_rules, language_codes, pivotal_mix, prefix_trie, preference_ranker, secret_forest, sentencepiece_codec, simhash, token_rollups, uniform_shards, zip_warc
from aerotally.plans.storage import table


def op1_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return bit_sliced_topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


def op2_preference_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_ranker.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents")).select("doc_id", "at", "token", "score", "is_secret")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollups.maintain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards.shard_documents(table(spark, sf_dir, "documents"), 16)


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("row_id"), "source", pivotal_mix.n_words(F.col("text")).alias("size"))
    found = pivotal_mix.mix_plan(rows)
    return found.select(F.col("row_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = zip_warc.write_archives(zip_warc.plan_records(table(spark, sf_dir, "pages")))
    found = zip_warc.read_archives(manifest, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations; defined results as in :mod:`prefix_trie`."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; defined results as in :mod:`language_codes`."""
    return language_codes.identify(table(spark, sf_dir, "documents"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of sources within their language and the terms behind it; defined results as in :mod:`divergence_audit`."""
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS a FROM w),
tri AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri WHERE c IS NOT NULL) y WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) z GROUP BY 1),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS upper_n
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  greatest(n_symbols / (nw * CAST(0.1 AS DOUBLE)), n_repeat_words / (nw * CAST(0.3 AS DOUBLE)), upper_n / (nl * CAST(0.5 AS DOUBLE)), CASE WHEN nc < nw * 2 OR nc > nw * 20 THEN CAST(2 AS DOUBLE) ELSE 0 END) AS severity
  FROM (SELECT *, CAST(greatest(n_words, 1) AS DOUBLE) AS nw, CAST(greatest(word_chars, 1) AS DOUBLE) AS nc, CAST(greatest(letters, 1) AS DOUBLE) AS nl FROM m) mm),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed OR severity > 1 THEN 1 ELSE 0 END) AS DOUBLE) AS x FROM f GROUP BY 1),
s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(x * x / n) AS xx, least(greatest(sum(x) / sum(n), 0.5 / (sum(n) + 1)), 1 - 0.5 / (sum(n) + 1)) AS mean FROM h),
v AS (SELECT *, mean * (1 - mean) AS spread, CASE WHEN k > 1 THEN (xx - n * mean * mean - (k - 1) * mean * (1 - mean)) / greatest(n - nn / n, 1e-9) ELSE 0 END AS b FROM s),
g AS (SELECT mean, CASE WHEN b <= spread / (n + 1) THEN n ELSE greatest(spread / b - 1, 1e-3) END AS strength FROM v),
r AS (SELECT host, (x + mean * strength) / (n + strength) AS rate, mean / (1 - mean) AS corpus FROM h, g),
o AS (SELECT host, rate / (1 - rate) / corpus AS odds FROM r),
t AS (SELECT host, CASE WHEN odds > 4 THEN -1 ELSE least(CAST(1.5 AS DOUBLE), greatest(CAST(0.5 AS DOUBLE), 1 / (odds * odds))) END AS tolerance FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND severity <= tolerance AS kept
FROM f JOIN t ON f.host = t.host
"""


OP10_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS last_id, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.n > 1 AND p.payload_bytes >= 1000 AND p.page_id < g.last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.n > 1 AND p.payload_bytes >= 1000 AND p.page_id < g.last_id THEN g.last_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bit_sliced_topk, op2_preference_ranker, op3_secret_forest, op4_simhash_near_dedup, op5_token_rollups, op6_host_rules, op7_uniform_shards, op8_pivotal_mix, op9_sentencepiece_codec, op10_zip_warc, op11_prefix_trie, op12_language_codes, op13_divergence_audit)}


OP1_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), ints AS (
  SELECT r, vec_id, len(embedding) AS n, generate_subscripts(embedding, 1) AS d, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS v FROM usable
), asked AS (
  SELECT min(r) AS r FROM usable WHERE vec_id % 50 = 0 GROUP BY vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.r AS candidate, c.vec_id AS vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM asked JOIN ints q ON asked.r = q.r JOIN ints c ON q.d = c.d AND q.n = c.n AND q.vec_id <> c.vec_id
  GROUP BY ALL
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
counted AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
langs AS (SELECT lang, count(*) + sum(n) AS below FROM kept GROUP BY 1),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(o.n, 0) + s.v) AS p,
    1 + 1000000000 * (k.n + 1) // l.below AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN apart x ON g.lang = x.lang AND g.source = x.source AND o.source = x.item
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_bit_sliced_topk": OP1_SQL, "op6_host_rules": OP6_SQL, "op10_zip_warc": OP10_SQL, "op13_divergence_audit": OP13_SQL}
