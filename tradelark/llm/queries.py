"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.llm.align import align_documents
from tradelark.llm.decontaminate import contained_items
from tradelark.llm.dedup import PASSAGE_WORDS, passage_digest
from tradelark.llm.jaccard import jaccard_components
from tradelark.llm.langid import identify_documents
from tradelark.llm.lm import score_documents
from tradelark.llm.packing import pack_documents
from tradelark.llm.shard import shard_by_bytes
from tradelark.llm.tokens import token_output
from tradelark.llm.topk import top_k
from tradelark.llm.trie import prefix_trie
from tradelark.llm.urls import judge_urls
from tradelark.llm.warc import archive_digest


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def language_bitmask(spark: SparkSession, folder: str) -> DataFrame:
    return identify_documents(_table(spark, folder, "documents"))


def hidden_markov_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(_table(spark, folder, "documents"))


def impact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(_table(spark, folder, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_output(_table(spark, folder, "documents"), tokenizer_path())


def token_group_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"))


def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_digest(_table(spark, folder, "documents"), words=PASSAGE_WORDS)


def url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"))


def benchmark_containment(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def histogram_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_by_bytes(_table(spark, folder, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def shared_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_table(spark, folder, "conversations"))


def sequential_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archive_digest(_table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_bitmask": language_bitmask,
    "op2_hidden_markov_scores": hidden_markov_scores,
    "op3_impact_top_k": impact_top_k,
    "op4_best_fit_packing": best_fit_packing,
    "op5_token_files": token_files,
    "op6_token_group_join": token_group_join,
    "op7_suffix_array_dedup": suffix_array_dedup,
    "op8_url_reputation": url_reputation,
    "op9_benchmark_containment": benchmark_containment,
    "op10_histogram_sharding": histogram_sharding,
    "op11_shared_cuts": shared_cuts,
    "op12_conversation_trie": conversation_trie,
    "op13_sequential_archives": sequential_archives,
}

SQL: dict[str, str] = {
    "op3_impact_top_k": """
WITH taking_part AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS value
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, len(q.value) + 1), lambda i: q.value[i] * c.value[i])), 0)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM taking_part WHERE vec_id % 50 = 0) q
  JOIN taking_part c ON c.vec_id <> q.vec_id AND len(c.value) = len(q.value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op6_token_group_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS both_have
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT one, other FROM shared JOIN sizes s ON s.doc_id = one JOIN sizes t ON t.doc_id = other
  WHERE 100 * both_have >= 90 * (s.n + t.n - both_have)),
reach AS (
  SELECT doc_id, doc_id AS met FROM documents
  UNION
  SELECT r.doc_id, l.other FROM reach r JOIN links l ON r.met = l.one)
SELECT r.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.met) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op8_url_reputation": """
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(decision, domain, start) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT DISTINCT p.host, p.path, arg_max(r.domain || r.start, length(r.domain || r.start)) AS rule,
    arg_max(r.decision, length(r.domain || r.start)) AS decision
  FROM (SELECT DISTINCT host, path FROM parsed) p JOIN rules r
    ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.start)
  GROUP BY p.host, p.path),
ruled AS (
  SELECT p.*, f.rule, f.decision, CASE f.decision WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS outcome
  FROM parsed p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(outcome) AS n, coalesce(sum(outcome), 0)::DOUBLE AS bad
  FROM ruled GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) AS prior
  FROM domains GROUP BY suffix),
suffix_weight AS (
  SELECT 1 / greatest(0.001, least(0.999, CASE WHEN sum(prior * (1 - prior) * (n - 1)) > 0
    THEN (sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / sum(prior * (1 - prior) * (n - 1)) ELSE 0.5 END)) - 1 AS weight
  FROM suffixes WHERE n > 0),
suffix_rates AS (SELECT suffix, (weight * prior + bad) / (weight + n) AS rate FROM suffixes, suffix_weight),
domain_priors AS (SELECT d.*, s.rate AS prior FROM domains d JOIN suffix_rates s USING (suffix)),
domain_weight AS (
  SELECT 1 / greatest(0.001, least(0.999, CASE WHEN sum(prior * (1 - prior) * (n - 1)) > 0
    THEN (sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / sum(prior * (1 - prior) * (n - 1)) ELSE 0.5 END)) - 1 AS weight
  FROM domain_priors WHERE n > 0),
domain_rates AS (SELECT domain, suffix, (weight * prior + bad) / (weight + n) AS rate FROM domain_priors, domain_weight),
host_priors AS (SELECT h.*, d.rate AS prior FROM hosts h JOIN domain_rates d USING (domain, suffix)),
host_weight AS (
  SELECT 1 / greatest(0.001, least(0.999, CASE WHEN sum(prior * (1 - prior) * (n - 1)) > 0
    THEN (sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / sum(prior * (1 - prior) * (n - 1)) ELSE 0.5 END)) - 1 AS weight
  FROM host_priors WHERE n > 0),
posterior AS (SELECT host, (weight * prior + bad) / (weight + n) AS rate, weight + n AS seen FROM host_priors, host_weight)
SELECT r.page_id, r.host, r.path, r.rule,
  coalesce(r.decision, CASE WHEN p.rate - 1.645 * sqrt(p.rate * (1 - p.rate) / (p.seen + 1)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN posterior p USING (host)
""",
    "op9_benchmark_containment": """
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM doc_words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared
  FROM doc_shingles JOIN item_shingles USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_shingles
""",
    "op12_conversation_trie": """
WITH ordered AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))) % 6 AS h
  FROM ordered),
rebuilt AS (
  SELECT t.conv_id, list_concat(coalesce(o.own[1:t.h], []), t.own[t.h + 1:]) AS turns
  FROM taken t LEFT JOIN ordered o ON o.conv_id = t.conv_id - t.conv_id % 100),
prefixes AS (
  SELECT conv_id, turns[1:d] AS path, d, len(turns) = d AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d),
childless AS (
  SELECT n.*, CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].text) ELSE 0 END AS own_saved,
    coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN (SELECT path[1:depth - 1] AS up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up) c ON c.up = n.path),
subtrees AS (
  SELECT path[1:d] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM childless) GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM childless n JOIN subtrees s ON s.top = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
""",
    "op13_sequential_archives": """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (
  SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads),
groups AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::BIGINT) AS twenty_bits FROM digests)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (twenty_bits[i // 4 + 1] >> (15 - 5 * (i % 4))) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM groups
""",
}
