"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    kept = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_join import near_classes

    return near_classes(_table(spark, sf_dir, "documents"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity

    docs = _table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    scored = score_texts(_table(spark, sf_dir, "documents"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits", "bits_per_byte")


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, quality

    docs = _table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import index, search

    return search(index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(_table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import audits, damage

    return audits(damage(_table(spark, sf_dir, "conversations")), "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_packing": op10_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_near_join": op4_near_join,
    "op1_topk": op1_topk,
    "op2_toxicity": op2_toxicity,
    "op8_extraction": op8_extraction,
    "op9_lm_scores": op9_lm_scores,
    "op7_sentencepieces": op7_sentencepieces,
    "op6_quality": op6_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_media": op12_media,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_substring_dedup"] = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(len(w) - 12)) AS p, w FROM d WHERE len(w) >= 13
), k AS (
  SELECT doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') AS win FROM s
), m AS (
  SELECT win, min(doc_id) AS first_doc FROM k GROUP BY win
), g AS (
  SELECT DISTINCT k.doc_id, unnest(range(k.p, k.p + 13)) AS i FROM k JOIN m USING (win) WHERE m.first_doc < k.doc_id
), a AS (
  SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id
), j AS (
  SELECT d.doc_id, d.w, coalesce(a.gone, []) AS gone FROM d LEFT JOIN a USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string([w[i + 1] FOR i IN range(len(w)) IF NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM j
"""

ORACLE_SQL["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL["op11_lexical_search"] = """
WITH d AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), f AS (
  SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL
), n AS (
  SELECT doc_id, sum(tf) AS n FROM f GROUP BY doc_id
), c AS (
  SELECT count(*) AS docs, sum(n) AS total FROM n
), q AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
), w AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t, docs
), s AS (
  SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * n.n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN f USING (t) JOIN n USING (doc_id), c GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL["op12_media"] = """
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), p AS (
  SELECT doc_id, n, CAST(greatest(64, (n + 63) // 64 * 64) AS BIGINT) AS size, b || unhex(repeat('00', CAST(greatest(64, (n + 63) // 64 * 64) - n AS INTEGER))) AS payload FROM t
), h AS (
  SELECT *, hex(payload) AS x, printf('%08x', size + 48) AS riff, printf('%08x', n) AS told, printf('%08x', size) AS data FROM p
), w AS (
  SELECT *, unhex('52494646' || riff[7:8] || riff[5:6] || riff[3:4] || riff[1:2] || '57415645666D7420' || '10000000' || '01000100' || '401F0000401F0000' || '01000800'
    || '66616374' || '04000000' || told[7:8] || told[5:6] || told[3:4] || told[1:2] || '64617461' || data[7:8] || data[5:6] || data[3:4] || data[1:2]) || payload AS media,
    list_transform(regexp_extract_all(x, '..'), lambda y: CAST('0x' || y AS INTEGER) - 128) AS v
  FROM h
)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(v[size - 63 : size], lambda y: list_transform(range(8), lambda i: CAST(((y + 128) >> CAST(i AS INTEGER)) & 1 AS BIGINT))))),
    lambda c, bit: CASE WHEN (xor(c, bit) & 1) = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) AS tail_crc32,
  CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256,
  array_to_string([CAST(list_sum(list_transform(v[s * size // 8 + 1 : (s + 1) * size // 8], lambda y: abs(y))) AS BIGINT) // (size // 8) FOR s IN range(8)], '-')
    || ';' || len(list_filter(list_zip(v[1 : size - 1], v[2 : size]), lambda z: (z[1] >= 0) <> (z[2] >= 0))) || ';' || list_max(list_transform(v, lambda y: abs(y))) AS feature
FROM w
"""

ORACLE_SQL["op13_conversations"] = """
WITH RECURSIVE n AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda x: list_transform(range(8), lambda i: CAST((ascii(x) >> CAST(i AS INTEGER)) & 1 AS BIGINT))))),
    lambda c, bit: CASE WHEN (xor(c, bit) & 1) = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) % 20 AS fate FROM n
), d AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h
), o AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    lag(role[1]) OVER w || role[1] AS pair
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM o
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM f GROUP BY conv_id
), ins(q, p, price, letters, lines) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', '\nuser:'), (0, 3, 10, 'II', '\nuser:\nassistant:'), (1, 1, 0, '', ''), (1, 2, 5, 'I', '\nuser:'), (1, 3, 10, 'II', '\nuser:\nassistant:'),
    (2, 2, 0, '', ''), (2, 3, 5, 'I', '\nassistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', '\nuser:')
), turn(p, q, role) AS (
  VALUES (0, 1, 'system'), (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), step AS (
  SELECT f.conv_id, f.i, x.q AS p, 'D' AS letter, x.q, 2 AS price, '' AS line FROM f, (VALUES (0), (1), (2), (3)) AS x(q)
  UNION ALL SELECT f.conv_id, f.i, t.p, 'K', t.q, CASE fault WHEN 't' THEN 5 ELSE 0 END, '\n' || f.role || ':' || f.text FROM f JOIN turn t ON f.role[1] = t.role[1] WHERE fault IN ('', 't')
  UNION ALL SELECT f.conv_id, f.i, t.p, 'R', t.q, CASE fault WHEN 't' THEN 6 ELSE 1 END, '\n' || t.role || ':' || f.text FROM f JOIN turn t ON t.q > 1 WHERE fault IN ('', 't')
), walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM f
  UNION ALL
  SELECT w.conv_id, s.i, s.q, min({'cost': w.best.cost + ins.price + s.price, 'audit': w.best.audit || ins.letters || s.letter, 'lines': w.best.lines || ins.lines || s.line})
  FROM walk w JOIN ins USING (q) JOIN step s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.p = ins.p GROUP BY ALL
), e AS (
  SELECT w.conv_id, min({'cost': w.best.cost + ins.price, 'audit': w.best.audit || ins.letters, 'lines': w.best.lines || ins.lines}) AS best
  FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.size = w.i JOIN ins USING (q) WHERE ins.p IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(substr(coalesce(e.best.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
