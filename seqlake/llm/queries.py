"""The queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embdedup import similar_vectors
from .exactdedup import exact_groups
from .jaccard import similar_components
from .langid import predict, train
from .mixing import Domains, learn_domains, mix
from .packing import pack, token_pieces
from .pii import BASE, find_spans, fit, span_text
from .quality import classify
from .warc import archive_pages
from .urls import ADDRESS, MAX_STRENGTH, MIN_STRENGTH, BLOCK_ABOVE, SUFFIXES, Z, host_of, host_reputation, judge_urls, path_of


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True).withColumnsRenamed({"id": "doc_id", "sha256": "text_sha256"})


OP7_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM documents
), r AS (
  SELECT doc_id, s, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
         row_number() OVER (PARTITION BY s ORDER BY doc_id DESC NULLS LAST) AS i
  FROM n
)
SELECT doc_id, keep_id, group_size, i = 1 AS kept, s AS text_sha256 FROM r
"""


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


#: Shares of tokens that documents of each kind shall have.
TARGET_WEIGHTS = {"good": 0.97, "low": 0.02, "toxic": 0.01}


def label_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Domains:
    """Classifier of the kinds that ``labels`` tells apart, learned from labelled rows of ``docs``."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_doc"), kind.alias("domain")).where("domain is not null")
    # One kind for a document with several labels, and only about as many rows as are fitted on.
    labels = labels.groupBy("_doc").agg(F.min("domain").alias("domain"))
    labelled = docs.select("doc_id", "text").join(labels.hint("merge"), F.col("doc_id") == F.col("_doc"))
    return learn_domains(labelled)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, label_domains(spark, docs, sf_dir), TARGET_WEIGHTS, columns=["doc_id"])


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes ``host, bad`` of the pages whose document (the number in their path) has labels."""
    pages = table(spark, sf_dir, "pages")
    named = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), "/([0-9]+)", 1).try_cast("long").alias("doc_id")).where("doc_id is not null")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    return named.join(table(spark, sf_dir, "labels").select("doc_id", bad), "doc_id").select("host", "bad")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), host_reputation(labelled_pages(spark, sf_dir)))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


_LEVEL_SQL = """
  SELECT CASE WHEN rho > 0 THEN least({most}, greatest({least}, (1 - rho) / rho)) ELSE {most} END AS strength, share FROM (
    SELECT share, CASE WHEN room > 0 THEN (spread - v * (g - 1)) / room ELSE 0 END AS rho FROM (
      SELECT share, v, g, w - t * share * share AS spread, v * (t - q / t - (g - 1)) AS room FROM (
        SELECT *, share * (1 - share) AS v FROM (
          SELECT sum(bad) / sum(n) AS share, sum(n)::DOUBLE AS t, count(*) AS g, sum(n::DOUBLE * n) AS q,
                 sum(n * (bad / n) * (bad / n)) AS w FROM {level}))))
"""
OP3_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), o AS (
  SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END AS bad
  FROM p JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)
), b AS (
  SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS bare
  FROM o WHERE bad IS NOT NULL GROUP BY host
), l AS (
  SELECT *, string_split(bare, '.') AS labels, regexp_matches(bare, '^[0-9]+(\\.[0-9]+){{3}}$') OR bare LIKE '[%' AS address,
         list_aggregate(string_split(bare, '.')[-2:], 'string_agg', '.') AS two FROM b
), h AS (
  SELECT host, n, bad,
         CASE WHEN address THEN bare WHEN two IN {SUFFIXES} THEN list_aggregate(labels[-3:], 'string_agg', '.') ELSE two END AS domain,
         CASE WHEN address THEN '{ADDRESS}' WHEN two IN {SUFFIXES} THEN two ELSE labels[-1] END AS suffix FROM l
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
ls AS ({_LEVEL_SQL.format(level="s", most=MAX_STRENGTH, least=MIN_STRENGTH)}),
ld AS ({_LEVEL_SQL.format(level="d", most=MAX_STRENGTH, least=MIN_STRENGTH)}),
lh AS ({_LEVEL_SQL.format(level="h", most=MAX_STRENGTH, least=MIN_STRENGTH)}),
ps AS (SELECT suffix, (bad + strength * share) / (n + strength) AS above FROM s, ls),
pd AS (SELECT domain, (bad + strength * above) / (n + strength) AS above FROM d JOIN ps USING (suffix), ld),
ph AS (SELECT host, (bad + strength * above) / (n + strength) AS mean, n + strength AS size FROM h JOIN pd USING (domain), lh),
r AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) AS low FROM ph),
j AS (
  SELECT page_id, p.host, path, low, CASE
    WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (p.host = 'org' OR p.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p LEFT JOIN r ON p.host = r.host
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN low > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.drop("lang"), model).drop("text")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder IS NOT NULL AND holder IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder IS DISTINCT FROM page_id THEN holder END AS refers_to
FROM h
"""


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


# Pairs within a label, which the hashing finds with a recall of almost one on these tables.
OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id, vec_id AS o FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.o = l.a
), c AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), word_vocabulary())
    return pack(pieces).withColumnRenamed("id", "doc_id")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, trusted_ids(spark, sf_dir)).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_spans": op1_pii_spans,
        "op2_source_mixing": op2_source_mixing,
        "op3_host_reputation": op3_host_reputation,
        "op4_language_id": op4_language_id,
        "op5_warc_index": op5_warc_index,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_host_reputation": OP3_SQL, "op5_warc_index": OP5_SQL, "op6_embedding_near_dedup": OP6_SQL, "op7_exact_dedup": OP7_SQL}
