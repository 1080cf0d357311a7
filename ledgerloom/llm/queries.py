"""The corpus operators as queries over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, bsi, chat, chosen_path, filter_audit, hard_negatives, langid, line_dedup, mixing, permutation, ring, simhash, warc
from ledgerloom.llm._shared import durable

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.maximal(_table(spark, sf_dir, "conversations")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).rows


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bsi.top_inner_products(_table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.digests(F.col("text"), path, public_tokenizers.PATTERN).alias("d")).select("doc_id", "d.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    texts = durable(pages.select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.page_text(F.col("html")).alias("text")))
    return line_dedup.drop_boilerplate(texts).select("page_id", "host", "lines_dropped", "text")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(_table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.flipped(_table(spark, sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_warc, op3_mixing, op4_simhash, op5_language_id, op6_top_k, op7_bpe, op8_line_dedup, op9_ann, op10_sharding, op11_hard_negatives, op12_filter_audit, op13_minhash)
}

#: The letters of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = " || ".join(f"substr('{BASE32}', (v >> {shift} & 31) + 1, 1)" for shift in (15, 10, 5, 0))
_TRIMMED = "trim(x, ' ' || chr(9) || chr(13))"
_LEFT = f"CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: {_TRIMMED} = '' OR NOT list_contains(bad, {_TRIMMED})) END"

ORACLES: dict[str, str] = {
    "op1_chat_formatting": rf"""WITH c AS (SELECT conv_id, list({{'r': coalesce(role, 'unknown'), 'x': coalesce(text, '')}} ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS turns FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM c)), u AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n FROM c GROUP BY turns)
SELECT conv_id, len(turns)::INTEGER AS n_turns, n AS n_copies, array_to_string(list_transform(turns, lambda t: '{chat.OPEN}' || replace(t.r, '<|', '<\|') || chr(10) || replace(t.x, '<|', '<\|') || '{chat.CLOSE}'), chr(10)) AS rendered
FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = u.turns)""",
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
d AS (SELECT page_id, string_agg({_LETTERS}, '' ORDER BY k) AS digest FROM (SELECT page_id, k, ('0x' || substr(x, (5 * k + 1)::INTEGER, 5))::BIGINT AS v FROM p, range(8) r(k)) GROUP BY page_id)
SELECT p.page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN p.page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f THEN f END AS refers_to FROM p JOIN d ON d.page_id = p.page_id""",
    "op6_top_k": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op8_line_dedup": rf"""WITH a AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<({line_dedup.HIDDEN})\b[^>]*>.*?</({line_dedup.HIDDEN})\s*>', ' ', 'g'), '(?i)</?({line_dedup.BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
t AS (SELECT page_id, host, string_split(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), chr(10)) AS lines FROM a),
l AS (SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: {_TRIMMED}), lambda x: x <> ''))) AS line FROM t WHERE host IS NOT NULL),
n AS (SELECT host, count(*) AS total FROM t GROUP BY host),
b AS (SELECT k.host, list(line) AS bad FROM (SELECT host, line, count(*) AS c FROM l GROUP BY ALL) k JOIN n ON n.host = k.host WHERE c >= 2 AND c > 0.2::DOUBLE * total GROUP BY k.host),
r AS (SELECT page_id, t.host, lines, {_LEFT} AS kept FROM t LEFT JOIN b ON b.host = t.host)
SELECT page_id, host, coalesce(len(lines) - len(kept), 0)::INTEGER AS lines_dropped, array_to_string(kept, chr(10)) AS text FROM r""",
    "op11_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, e.vec_id, e.label = q.label AS same, list_dot_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, (row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id))::INTEGER AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score, positive_rank
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 5""",
    "op12_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
m AS (SELECT d.part, (len(w) < 50)::INTEGER AS fa, (100 * len(list_distinct(w)) < 65 * len(w))::INTEGER AS fb, (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INTEGER AS fc,
  regexp_matches(t, '[#$%&*|]')::INTEGER AS fd, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS fe, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id AS id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id) l ON l.id = d.doc_id),
c AS (SELECT part, [fa, fb, fc, fd, fe] AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, o, i AS step, o[i] AS f_at, n, good, toxic, f[o[i]] = 1 AS fails, list_sum(f) AS n_fails, coalesce(list_sum(list_transform(o[1:i - 1], lambda x: f[x])), 0) > 0 AS earlier FROM c, o, l),
r AS (SELECT part, o, step, f_at, sum(CASE WHEN NOT earlier AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f_at))::BIGINT AS shapley FROM r""",
}
