"""Registered queries of the numbered operators, each over its whole table.

A query applies its operator with production parameters and derives the
columns of its contract from the operator's own output. ``ORACLE_SQL`` holds
DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm import (ann, decontaminate, dialogue, langid, line_dedup, minhash, mixing, negatives, quality, secrets,
                           sharding, tokens, warc)
from meterwise.llm.scratch import scratch_path


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, folder, "documents"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "shard_id", "shard_depth", "shard_bytes", "shard_rows")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    network = quality.train(docs, labels, langid.fold("doc_id", 3) != 1)
    scored = quality.classify(docs, network)
    return scored.select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.schedule(read(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = langid.train(docs, langid.fold("doc_id", 5) != 0)
    found = langid.identify(docs, model)
    return found.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "n_langs",
                        "langs")


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(read(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        F.col("all_spans").alias("spans"), "n_live", "n_copied")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(read(spark, folder, "pages"))


def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """With a cache of its own, so every distinct content is encoded once."""
    import public_tokenizers

    vocabulary = tokens.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
    return tokens.count_tokens(read(spark, folder, "documents"), vocabulary, scratch_path(spark, "token-cache"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations")
    return dialogue.repair(dialogue.damage(rows), rows)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_sharding, op3_quality, op4_mixing, op5_language_id, op6_decontamination,
              op7_secrets, op8_warc, op9_nearest, op10_near_duplicates, op11_token_counts, op12_conversations,
              op13_hard_negatives)
}


def sharding_sql(limit: int = sharding.LIMIT_BYTES) -> str:
    """Buckets by recursion: a bucket that is too large and holds more than
    one hash splits on its next bit."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), split AS (
  SELECT doc_id, n_bytes, h, 0 AS depth, '' AS id,
         sum(n_bytes) OVER ()::BIGINT AS bytes, count(*) OVER () AS n, min(h) OVER () <> max(h) OVER () AS several
  FROM d
  UNION ALL
  SELECT doc_id, n_bytes, h, depth, id, sum(n_bytes) OVER w::BIGINT, count(*) OVER w, min(h) OVER w <> max(h) OVER w
  FROM (SELECT doc_id, n_bytes, h, depth + 1 AS depth, id || ((h >> (59 - depth)) & 1)::VARCHAR AS id
        FROM split WHERE bytes > {limit} AND several)
  WINDOW w AS (PARTITION BY id)
)
SELECT doc_id, n_bytes, id AS shard_id, depth::INTEGER AS shard_depth, bytes AS shard_bytes, n AS shard_rows
FROM split WHERE NOT (bytes > {limit} AND several)"""


DECONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM bl)
), lens AS (SELECT DISTINCT n FROM wins
), dwin AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (SELECT r, dwin.n, i, item_id FROM dwin JOIN wins ON dwin.n = wins.n AND dwin.win = wins.win
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""

_ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
           r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _span_sql(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    """Spans of one kind: a match starts after the gaps and matches before it."""
    return f"""
SELECT r, source, '{kind}' AS kind, {rank} AS rank, v[i] AS value,
       (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(
        list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b, length(m[i]) AS n
FROM (SELECT r, source, m, v, g, unnest(generate_series(1, len(m))) AS i FROM (
  SELECT r, source, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
         regexp_split_to_array(t, '{pattern}') AS g FROM docs WHERE regexp_matches(t, '{pattern}')))
WHERE {keep}"""


SECRETS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), base AS ({_span_sql('assign', 1, _ASSIGN, 2, "length(v[i]) >= 8")}
UNION ALL {_span_sql('access', 2, 'AKIA[A-Z0-9]+', 0, "length(m[i]) >= 16")}
UNION ALL {_span_sql('hex', 3, '[0-9a-f]{32,}', 0, "true")}
), extra AS (
  SELECT * FROM ({_span_sql('owned', 4, '[A-Za-z0-9+/_=-]{20,}', 0,
                            "regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]')")}) x
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = x.r AND base.b < x.b + x.n AND x.b < base.b + base.n)
), spans AS (SELECT * FROM base UNION ALL SELECT * FROM extra
), owners AS (
  SELECT value, count(*) AS owners
  FROM (SELECT DISTINCT value, coalesce(source, '') AS o, source IS NULL AS u FROM spans) GROUP BY value
), judged AS (
  SELECT r, kind, rank, b, b + n AS e, owners FROM spans JOIN owners USING (value) WHERE rank < 4 OR owners < {secrets.WIDE_OWNERS}
), digest AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 4) AS base_spans,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS all_spans,
         count(*) FILTER (owners < {secrets.WIDE_OWNERS}) AS n_live, count(*) FILTER (owners >= {secrets.WIDE_OWNERS}) AS n_copied
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(all_spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM docs LEFT JOIN digest USING (r)"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS s FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS top,
         array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(s, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS digest
  FROM p
)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM d"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r
), pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * common >= 75 * (a.n + b.n - common)
), edges AS (SELECT a.doc_id AS x, b.doc_id AS y FROM links JOIN w a ON a.r = x JOIN w b ON b.r = y
), both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges
), reach AS (SELECT x, y FROM both_ways UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x
), label AS (SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
       doc_id IS NOT DISTINCT FROM least(doc_id, coalesce(y, doc_id)) AS kept
FROM w LEFT JOIN sizes USING (r) LEFT JOIN label ON label.x = doc_id"""

CONVERSATIONS_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                   lambda ch: ascii(ch)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
                             xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv_id, turn, IF(kind = 4, 'user', role) AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE kind <> 0
), n AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (w ROWS UNBOUNDED PRECEDING) AS i,
         lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), m AS (
  SELECT *, CASE WHEN tail = '' THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM n
), arcs(e, s, ini, t, cost) AS (
  VALUES ('D', 0, NULL, 0, 4), ('D', 1, NULL, 1, 4), ('D', 2, NULL, 2, 4), ('D', 3, NULL, 3, 4),
         ('R', 0, NULL, 2, 3), ('R', 1, NULL, 2, 3), ('R', 2, NULL, 3, 3), ('R', 3, NULL, 2, 3),
         ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0)
), adds(s, t, cost, e, said) AS (
  SELECT s, s, 0, '', '' FROM range(4) x(s)
  UNION ALL VALUES (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'),
    (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 2, 3, 'I', chr(10) || 'user:'),
    (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), best AS (
  SELECT conv_id, 0::BIGINT AS i, t AS s, {'cost': cost, 'audit': e, 'said': said} AS b
  FROM (SELECT DISTINCT conv_id FROM n), adds WHERE s = 0
  UNION ALL
  SELECT conv_id, i, s, min(b) FROM (
    SELECT best.conv_id, m.i, adds.t AS s, {
      'cost': best.b.cost + arcs.cost + adds.cost + IF(m.fault = 't' AND arcs.e <> 'D', 3, 0),
      'audit': best.b.audit || arcs.e || adds.e,
      'said': best.b.said || CASE arcs.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text
              ELSE chr(10) || IF(arcs.t = 2, 'user:', 'assistant:') || m.text END || adds.said} AS b
    FROM best JOIN m ON m.conv_id IS NOT DISTINCT FROM best.conv_id AND m.i = best.i + 1
    JOIN arcs ON arcs.s = best.s AND (arcs.e = 'D' OR m.fault NOT IN ('b', 'd')) AND (arcs.e <> 'K' OR arcs.ini = m.ini)
    JOIN adds ON adds.s = arcs.t
  ) GROUP BY conv_id, i, s
), marks AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal
  FROM m GROUP BY conv_id
), done AS (
  SELECT marks.conv_id, min(b) AS b FROM best JOIN marks ON marks.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = n
  WHERE s IN (0, 3) GROUP BY marks.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(substr(b.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN marks ON marks.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""

HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, IF(vec_id % 7 = 0, (label + 1) % 10, label) AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS id,
         coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score
  AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3"""

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": sharding_sql(),
    "op6_decontamination": DECONTAMINATION_SQL,
    "op7_secrets": SECRETS_SQL,
    "op8_warc": WARC_SQL,
    "op10_near_duplicates": NEAR_DUPLICATES_SQL,
    "op12_conversations": CONVERSATIONS_SQL,
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
