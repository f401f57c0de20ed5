"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, lmscore, mixing, neardup, quality, tokens, topk, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep of every document."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    return token_files(_table(spark, sf_dir, "documents"))


def token_files(docs: DataFrame) -> DataFrame:
    """docs written as files of token ids, read back."""
    import public_tokenizers

    files = tokens.write(docs, str(public_tokenizers.path("byte_bpe_50k.json")), end_id=2)
    return tokens.read(files, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every vector whose id is divisible by 50."""
    return topk.search(_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.draw(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '!|#$%&*<>{}', '')), 0) AS marks,
         md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS digest
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / (CASE WHEN size > 0 THEN greatest(0.25, size / (size + marks)::DOUBLE) ELSE 1.0 END) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT source, size, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * size / w, source NULLS LAST) AS pos FROM w
), c AS (
  SELECT *, (sum(size) OVER () - 3 * (sum(size) OVER (ORDER BY pos) - size))::BIGINT AS rest,
         (sum(w) OVER () - (sum(w) OVER (ORDER BY pos) - w))::BIGINT AS share
  FROM o
), f AS (
  SELECT min(pos) AS first FROM c WHERE rest * w <= 3 * size * share
), l AS (
  SELECT c.rest AS rest, c.share AS share, f.first FROM f JOIN c ON c.pos = f.first
), t AS (
  SELECT c.source, c.size AS source_size,
         CASE WHEN c.pos < l.first THEN (3 * c.size)::DOUBLE ELSE (l.rest * c.w)::DOUBLE / l.share::DOUBLE END AS target
  FROM c, l
), e AS (
  SELECT *, floor(target + 0.5)::BIGINT AS whole,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs
  FROM t
)
SELECT k.doc_id, k.size, e.source_size, e.target,
       (e.epochs * k.size + greatest(0, least(k.size, e.whole - e.epochs * e.source_size
         - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.digest
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every page."""
    return urls.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity of every document and benchmark item that it holds."""
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, on shingles of four words."""
    return neardup.cluster(_table(spark, sf_dir, "documents"), k=4)


#: Links by prefix filtering: of sets with the given similarity, the rarest shingles of each have one in common.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) END AS grams
  FROM w
), s AS (
  SELECT list_sort(grams) AS grams, min(doc_id) AS rep FROM g WHERE len(grams) > 0 GROUP BY 1
), x AS (
  SELECT rep, len(grams) AS n, unnest(grams) AS gram FROM s
), f AS (
  SELECT rep, n, x.gram, row_number() OVER (PARTITION BY rep ORDER BY c.df, x.gram) AS nth
  FROM x JOIN (SELECT gram, count(*) AS df FROM x GROUP BY gram) c USING (gram)
), p AS (
  SELECT rep, n, gram FROM f WHERE nth <= n - ceil(0.8 * n) + 1
), c AS (
  SELECT DISTINCT a.rep AS u, b.rep AS v FROM p a JOIN p b ON a.gram = b.gram AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), l AS (
  SELECT u, v FROM c JOIN s a ON a.rep = u JOIN s b ON b.rep = v
  WHERE 180 * len(list_intersect(a.grams, b.grams)) >= 80 * (len(a.grams) + len(b.grams))
), e AS (
  SELECT u, v FROM l UNION SELECT v, u FROM l
), r AS (
  SELECT rep AS node, rep AS root FROM s UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node AND r.root < e.v
), k AS (
  SELECT node, min(root) AS least FROM r GROUP BY node
)
SELECT g.doc_id, len(g.grams)::BIGINT AS n_shingles, coalesce(k.least, g.doc_id) AS component_id, g.doc_id = coalesce(k.least, g.doc_id) AS kept
FROM g LEFT JOIN s ON s.grams = list_sort(g.grams) LEFT JOIN k ON k.node = s.rep
"""


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


_PHRASES = ", ".join(f"({i}, '{t}', '{label}', {i < len(licenses.PHRASES)})" for i, (t, label) in enumerate([*licenses.PHRASES, *licenses.TEMPLATES]))
OP8_SQL = rf"""
WITH t AS (
  SELECT id, string_split(phrase, ' ') AS words, label, base FROM (VALUES {_PHRASES}) AS v(id, phrase, label, base)
), tg AS (
  SELECT id, label, base, len(words) AS size, i - 1 AS t, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM t)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
), dg AS (
  SELECT doc_id, i - 1 AS p, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM d)
), h AS (
  SELECT doc_id, tg.id, label, base, size, t, p - t AS diagonal, p FROM dg JOIN tg USING (gram)
), b AS (
  SELECT doc_id, diagonal AS start, label FROM h WHERE base GROUP BY doc_id, id, label, size, diagonal HAVING count(DISTINCT t) = size - 2
), n AS (
  SELECT *, sum(CASE WHEN diagonal - before <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS run
  FROM (SELECT DISTINCT doc_id, id, diagonal, lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS before
        FROM (SELECT DISTINCT doc_id, id, diagonal FROM h WHERE NOT base))
), m AS (
  SELECT h.doc_id, h.id, h.label, h.size, n.run, min(p) AS first, max(p) + 3 AS last, len(list_distinct(flatten(list([t, t + 1, t + 2])))) AS covered
  FROM h JOIN n ON h.doc_id = n.doc_id AND h.id = n.id AND h.diagonal = n.diagonal GROUP BY ALL
), v AS (
  SELECT doc_id, label, covered / size AS cover FROM m WHERE covered >= 0.75 * size AND last - first <= size / 0.75
), a AS (
  SELECT doc_id, label, 1.0::DOUBLE AS cover FROM b UNION ALL SELECT doc_id, label, cover FROM v
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_base, x.first_word::BIGINT AS first_word, x.last_word::BIGINT AS last_word,
       coalesce(x.labels, '') AS base_labels, coalesce(y.labels, '') AS labels, coalesce(y.score, 0.0)::DOUBLE AS score
FROM d
LEFT JOIN (SELECT doc_id, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id) x USING (doc_id)
LEFT JOIN (SELECT doc_id, max(cover) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM a GROUP BY doc_id) y USING (doc_id)
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, score of every document."""
    return lmscore.score(_table(spark, sf_dir, "documents"), lmscore.target_ids(_table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back. A gap is an error."""
    pages = _table(spark, sf_dir, "pages")
    gap = F.raise_error(F.concat(F.lit("a gap in "), "path", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "gap"))
    back = warc.read(warc.write(pages)).filter(F.when(F.col("gap").isNull(), True).otherwise(gap.cast("boolean")))
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_tokens": op2_tokens, "op3_topk": op3_topk, "op4_mixing": op4_mixing, "op5_url_filters": op5_url_filters, "op6_decontamination": op6_decontamination, "op7_minhash": op7_minhash, "op8_license_scans": op8_license_scans, "op9_lm_scoring": op9_lm_scoring, "op10_warc": op10_warc}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op4_mixing": OP4_SQL, "op7_minhash": OP7_SQL, "op8_license_scans": OP8_SQL, "op10_warc": OP10_SQL}
