"""Registered queries of the subpackage, one per operator with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import language_id, line_crf
from .common import read
from .conversation_trie import conversation_trie
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .hard_negatives import mine
from .jaccard_join import jaccard_components
from .mixing import poisson_mix
from .suffix_dedup import remove_repeats
from .surrogates import replace_personal_data
from .token_shards import shard_folder, training_order, with_shards
from .topk_search import top_k
from .warc import BLOCKS, HIDDEN, responses_of_pages, warc_derivatives

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read(spark, sf_dir, "documents"), keep={}, digest="text_sha256")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op3_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


@query
def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poisson_mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "rate", "n_copies", "copy", "mix_key", "text")


ORACLES["op10_poisson_mixing"] = """
WITH s AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS sources FROM documents GROUP BY source),
r AS (SELECT source, CAST(total AS DOUBLE) * 1.0 / CAST(sources AS DOUBLE) / n AS rate FROM s),
k AS (SELECT source, rate, unnest(generate_series(0, CAST(floor(rate + 12 * sqrt(rate) + 30) AS INT))) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
cdf AS (SELECT source, rate, list(cdf) AS cdf FROM c GROUP BY source, rate),
d AS (
  SELECT d.doc_id, d.source, d.text, cdf.rate,
    CAST(len(list_filter(cdf.cdf, lambda x: x <= CAST('0x' || substr(md5('17:' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0)) AS INT) AS n_copies
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
)
SELECT doc_id, source, rate, n_copies, copy, md5('17-order:' || doc_id || ':' || copy) AS mix_key, text
FROM (SELECT *, CAST(unnest(generate_series(0, n_copies - 1)) AS INT) AS copy FROM d WHERE n_copies > 0)
"""


@query
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives(responses_of_pages(read(spark, sf_dir, "pages")), keys=("page_id",))


# The SQL says with patterns what the operator finds in one pass; these references are all that it decodes.
ENTITIES = {"nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}
HIDDEN_RE = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{t}\b.*?(?:</{t}[^>]*>|\z)" for t in HIDDEN) + ")"
BLOCK_RE = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>"
TAG_RE = r"<[A-Za-z/!?][^>]*>"
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title"
LANG_RE = r"""(?i)<html\b[^>]*?[\s"'/:]lang\s*=\s*["']?([A-Za-z-]+)"""
CHARSET_RE = r"""(?i)<meta\b[^>]*?\bcharset\s*=\s*["']?([A-Za-z0-9_-]+)"""
LINK_RE = r"""(?i)<a\b[^>]*?[\s"'/]href\s*=\s*["']([^"']*)["']"""


def _sql_references(t: str) -> str:
    for name, char in ENTITIES.items():
        t = f"replace({t}, '&{name};', '{char}')"
    return t


def _sql_text(html: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate(regexp_replace({html}, {q(HIDDEN_RE)}, ' ', 'g'), chr(9) || chr(13) || chr(10) || chr(12), '    ')"
    t = f"regexp_replace(regexp_replace({t}, {q(BLOCK_RE)}, chr(10), 'g'), {q(TAG_RE)}, '', 'g')"
    t = _sql_references(t)
    t = f"regexp_replace(regexp_replace({t}, '[ \u00a0]{{2,}}|\u00a0', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({t}, '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"


def _sql_urn(text: str) -> str:
    h = f"md5({text})"
    return f"'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_CRLF = "chr(13) || chr(10)"
_RE = {n: p.replace("'", "''") for n, p in (("title", TITLE_RE), ("lang", LANG_RE), ("charset", CHARSET_RE), ("link", LINK_RE))}
ORACLES["op1_warc_derivatives"] = f"""
WITH r AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS body, {_sql_urn("'response|' || page_id || '|' || coalesce(url, '')")} AS refers_to,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) AS source_headers
  FROM pages
), f AS (
  SELECT *, 'sha256:' || sha256(body) AS payload_digest,
    regexp_replace({_sql_references(f"regexp_extract(body, '{_RE['title']}', 1)")}, '[ \t\r\n]+', ' ', 'g') AS title,
    regexp_extract(body, '{_RE["lang"]}', 1) AS lang, regexp_extract(body, '{_RE["charset"]}', 1) AS charset,
    list_transform(regexp_extract_all(body, '{_RE["link"]}', 1), lambda u: trim(regexp_replace({_sql_references("u")}, '[\t\r\n]', '', 'g'), ' ')) AS links
  FROM r
), b AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'sourceDigest: ' || payload_digest || {_CRLF} || 'sourceLength: ' || octet_length(encode(body)) || {_CRLF} || 'httpStatus: 200' || {_CRLF} || 'contentType: text/html' || {_CRLF}
    || 'sourceHeader: ' || replace(source_headers, {_CRLF}, {_CRLF} || 'sourceHeader: ') || {_CRLF} || CASE WHEN title <> '' THEN 'title: ' || title || {_CRLF} ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || {_CRLF} ELSE '' END
    || CASE WHEN charset <> '' THEN 'charset: ' || charset || {_CRLF} ELSE '' END
    || array_to_string(list_transform(links, lambda u: 'outlink: ' || u || {_CRLF}), '') AS block
  FROM f
  UNION ALL SELECT *, 'conversion', 'text/plain', {_sql_text("body")} FROM f
), o AS (
  SELECT page_id, record_type, {_sql_urn("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type,
    octet_length(encode(block)) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest, source_headers, block
  FROM b
)
SELECT *, 'WARC/1.1' || {_CRLF} || 'WARC-Type: ' || record_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Refers-To: ' || refers_to || {_CRLF}
  || 'WARC-Target-URI: ' || target_uri || {_CRLF} || 'WARC-Date: ' || date || {_CRLF} || 'WARC-Block-Digest: ' || block_digest || {_CRLF}
  || 'WARC-Payload-Digest: ' || payload_digest || {_CRLF} || 'Content-Type: ' || content_type || {_CRLF} || 'Content-Length: ' || content_length || {_CRLF} AS header
FROM o
"""


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), n=4, num=85, den=100)


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def fold(n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold(4) != 2))
    return language_id.identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    field = line_crf.train(docs, labels.where(fold(5) != 0))
    scored = line_crf.score_documents(docs, field)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


@query
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(read(spark, sf_dir, "documents"), key="surrogate-key-1")


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shards(training_order(read(spark, sf_dir, "documents")), shard_folder(spark))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


_CRC = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * CAST(3988292384 AS BIGINT))))"""
ORACLES["op11_conversation_trie"] = f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT *, md5(strlen(role) || ':' || role || text) AS m FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS k FROM m),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC.format(s="CAST(conv_id AS VARCHAR)")}, CAST(4294967295 AS BIGINT)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM s)),
r AS (
  SELECT c.conv_id, 0 AS part, t.k, t.m, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.m, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h
),
q AS (SELECT c.conv_id, coalesce(list(r.m ORDER BY part, k) FILTER (WHERE r.m IS NOT NULL), []) AS path, list(len(regexp_extract_all(r.text, '[^\x20\x09-\x0D]+')) ORDER BY part, k) FILTER (WHERE r.m IS NOT NULL) AS words FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path, words FROM q),
n AS (
  SELECT depth, path[1:depth] AS node, path[1:greatest(depth - 1, 0)] AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(CASE WHEN depth = 0 THEN 0 ELSE words[depth] END) AS spared,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM p GROUP BY depth, path[1:depth], path[1:greatest(depth - 1, 0)]
),
k AS (SELECT n.depth, n.node, count(b.node) AS n_children FROM n LEFT JOIN n b ON b.depth = n.depth + 1 AND b.above = n.node GROUP BY n.depth, n.node),
up AS (SELECT unnest(range(0, n.depth + 1)) AS lvl, n.node, n.spared, k.n_children FROM n JOIN k ON k.depth = n.depth AND k.node = n.node),
u AS (SELECT lvl AS depth, node[1:lvl] AS node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(spared) AS BIGINT) AS saved_tokens FROM up GROUP BY lvl, node[1:lvl])
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN k ON k.depth = n.depth AND k.node = n.node JOIN u ON u.depth = n.depth AND u.node = n.node LEFT JOIN n a ON a.depth = n.depth - 1 AND a.node = n.above
"""


@query
def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), k=5, every=50)


_DOT = "list_sum(list_transform(range(1, 1 + least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i]))"
_WHOLE = """
  SELECT row_number() OVER () AS r, vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""
ORACLES["op12_exact_topk"] = f"""
WITH w AS ({_WHOLE.format(label="0")}),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(coalesce({_DOT}, 0) AS BIGINT) AS score FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.r <> b.r)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), n_positives=5, n_negatives=3, low=50, high=95, every=50)


ORACLES["op13_hard_negatives"] = f"""
WITH w AS (SELECT * FROM ({_WHOLE.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")}) WHERE label IS NOT NULL),
s AS (SELECT a.r, b.r AS other, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce({_DOT}, 0) AS BIGINT) AS score FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
