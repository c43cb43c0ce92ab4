"""The queries that `__spark_entry__` registers for this subpackage, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelab.llm import anchors, bktree, lattice, line_minhash, merkle, minimax, multiprobe, phrase_index, pivots, prefix_counts, quotes, resample, vector_codes
from gatelab.llm.runtime import read_parquet


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given messages quote nothing, so they are linked as mail in which each quotes those before it."""
    return quotes.link_quotes(quotes.as_mail(read_parquet(spark, sf_dir, "conversations")))


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_parquet(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = lattice.encode(docs, check_col="lossless")
    return pieces.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "lossless")


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(read_parquet(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20, scale=64)


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prefix_counts.prefix_table(read_parquet(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return table.select("doc_id", "n_bytes", "n_tokens", prefix_counts.over_limit(1024).alias("over_limit"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_parquet(spark, sf_dir, "documents"), read_parquet(spark, sf_dir, "labels"))


def op6_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.digest(anchors.remove_repeats(read_parquet(spark, sf_dir, "documents"), 13))


def op7_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(read_parquet(spark, sf_dir, "documents"), read_parquet(spark, sf_dir, "benchmark"))
    return phrase_index.report(found)


def op8_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = minimax.shard_by_bytes(read_parquet(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_minhash.dedup_lines(read_parquet(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bktree.simhash_components(read_parquet(spark, sf_dir, "documents"))
    return found.select("doc_id", bktree.hex_fingerprint().alias("fingerprint"), "component_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tree = merkle.manifest(read_parquet(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.translate("text", _UPPER, _LOWER)}, tampered)
    return tree.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read_parquet(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest_of(books)).alias("codebooks_sha256"))


def op13_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest(read_parquet(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_sampled_pieces,
        op3_pivot_top_k,
        op4_prefix_token_counts,
        op5_importance_resampling,
        op6_fixed_block_anchors,
        op7_positional_decontamination,
        op8_minimax_sharding,
        op9_line_minhash,
        op10_simhash_components,
        op11_merkle_manifest,
        op12_vector_codes,
        op13_multiprobe_neighbours,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_quotation_linking": quotes.MAIL_SQL,
    "op3_pivot_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_fixed_block_anchors": r"""
WITH d AS (
  SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) WHERE len(w) >= 13
), f AS (
  SELECT win, min(doc_id) AS least FROM g GROUP BY win
), hit AS (
  SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN f USING (win), range(0, 13) t(k) WHERE f.least < g.doc_id
), gone AS (
  SELECT doc_id, list(i) AS gone FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE [w[i] for i in range(1, len(w) + 1) if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
""",
    "op7_positional_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw), g AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), m AS (
  SELECT doc_id, i, g.n, item FROM g JOIN bw ON bw.n = g.n AND bw.win = g.win
), h AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE bits AS (
  SELECT [list_reduce([CAST(k AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) for k in range(0, 256)] AS t
), d AS (
  SELECT doc_id, source, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, text,
    xor(4294967295, list_reduce(list_concat([4294967295], [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS crc
  FROM documents, bits
), e AS (
  SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(concat(head, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) END AS changed
  FROM d
), ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM e
), up AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY idx) AS h FROM ranked GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, [sha256(array_to_string(h[16 * i + 1 : 16 * i + 16], '')) for i in range(0, (len(h) + 15) // 16)] FROM up WHERE len(h) > 1
), sub AS (
  SELECT tree, h[1] AS subroot, level AS top FROM up WHERE len(h) = 1
), over AS (
  SELECT 0 AS level, list(subroot ORDER BY tree) AS h FROM sub HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, [sha256(array_to_string(h[16 * i + 1 : 16 * i + 16], '')) for i in range(0, (len(h) + 15) // 16)] FROM over WHERE len(h) > 1
), levels AS (
  SELECT tree, level, h FROM up WHERE len(h) > 1
  UNION ALL
  SELECT tree, top + over.level, over.h FROM sub, over WHERE len(over.h) > 1
), fold AS (
  SELECT r.tree, r.idx, 0 AS level, CASE WHEN s.top = 0 THEN r.tree ELSE r.idx END AS i, coalesce(changed, leaf) AS x, '' AS beside FROM ranked r JOIN sub s USING (tree)
  UNION ALL
  SELECT f.tree, f.idx, f.level + 1, CASE WHEN f.level + 1 = s.top THEN f.tree ELSE f.i // 16 END,
    sha256(concat(array_to_string(h[f.i - f.i % 16 + 1 : f.i], ''), x, array_to_string(h[f.i + 2 : f.i - f.i % 16 + 16], ''))),
    concat(beside, array_to_string(h[f.i - f.i % 16 + 1 : f.i], ''), array_to_string(h[f.i + 2 : f.i - f.i % 16 + 16], ''))
  FROM fold f JOIN sub s ON s.tree = f.tree JOIN levels l ON l.tree = f.tree AND l.level = f.level
), done AS (
  SELECT tree, idx, arg_max(x, level) AS folded_root, arg_max(beside, level) AS beside FROM fold GROUP BY tree, idx
)
SELECT r.doc_id, r.leaf, s.subroot, o.h[1] AS root, sha256(d.beside) AS proof_sha256, d.folded_root, d.folded_root = o.h[1] AS verified
FROM ranked r JOIN sub s USING (tree) JOIN done d USING (tree, idx), over o WHERE len(o.h) = 1
""",
    "op12_vector_codes": """
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), v AS MATERIALIZED (
  SELECT vec_id, n, part, x[len(x) // 16 * part + 1 : len(x) // 16 * (part + 1)] AS x FROM kept, range(0, 16) p(part)
), b0 AS (
  SELECT part, n AS entry, x FROM v WHERE n < 64
), a0 AS MATERIALIZED (
  SELECT v.vec_id, v.n, v.part, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
  FROM v JOIN b0 b ON b.part = v.part, LATERAL (SELECT CAST(list_sum([(v.x[i] - b.x[i]) * (v.x[i] - b.x[i]) for i in range(1, len(v.x) + 1)]) AS BIGINT) AS d) t
  GROUP BY v.vec_id, v.n, v.part
), m0 AS (
  SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM (
    SELECT a.part, a.entry, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS c FROM a0 a JOIN v ON v.n = a.n AND v.part = a.part, LATERAL (SELECT unnest(range(1, len(v.x) + 1)) AS i) u
    GROUP BY a.part, a.entry, i) t GROUP BY part, entry
), b1 AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b0 b LEFT JOIN m0 m ON m.part = b.part AND m.entry = b.entry
), a1 AS MATERIALIZED (
  SELECT v.vec_id, v.n, v.part, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
  FROM v JOIN b1 b ON b.part = v.part, LATERAL (SELECT CAST(list_sum([(v.x[i] - b.x[i]) * (v.x[i] - b.x[i]) for i in range(1, len(v.x) + 1)]) AS BIGINT) AS d) t
  GROUP BY v.vec_id, v.n, v.part
), m1 AS (
  SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM (
    SELECT a.part, a.entry, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS c FROM a1 a JOIN v ON v.n = a.n AND v.part = a.part, LATERAL (SELECT unnest(range(1, len(v.x) + 1)) AS i) u
    GROUP BY a.part, a.entry, i) t GROUP BY part, entry
), b2 AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b1 b LEFT JOIN m1 m ON m.part = b.part AND m.entry = b.entry
), a2 AS MATERIALIZED (
  SELECT v.vec_id, v.n, v.part, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
  FROM v JOIN b2 b ON b.part = v.part, LATERAL (SELECT CAST(list_sum([(v.x[i] - b.x[i]) * (v.x[i] - b.x[i]) for i in range(1, len(v.x) + 1)]) AS BIGINT) AS d) t
  GROUP BY v.vec_id, v.n, v.part
), c AS (
  SELECT n, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM kept JOIN c USING (n)
""",
}
