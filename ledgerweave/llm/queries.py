"""The registered queries of the text operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import (
    anchors, ann, bpe, deal, hardneg, jaccard, lines, media, mixing, quality, spelling, suffixes,
    tokens, toxicity,
)
from ledgerweave.session import apply_runtime_defaults, written

FOLDS = 5
DOMAINS = {"clean": 0.89, "toxic": 0.05, "junk": 0.06}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    apply_runtime_defaults(spark)
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def _digest(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def _for_documents(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Results of texts for each document; digests are taken before texts would be moved."""
    narrow, _ = written(found, name)
    return deal.keyed(docs, "text", "doc_id").join(narrow, deal.KEY, "left").drop(*deal.KEY)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents outside strings of 200 bytes that start more than once."""
    docs = table(spark, sf_dir, "documents")
    found = suffixes.repeated_bytes(deal.distinct_texts(docs))
    digest = _digest("kept").alias("kept_sha256")
    found = found.select("k1", "k2", "n_bytes", "n_removed", "n_spans", digest)
    return _for_documents(docs, found, "byte-digests")


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
),
windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * suffixes.LENGTH})) AS w
  FROM (SELECT *, unnest(range(0, length(h) // 2 - {suffixes.LENGTH - 1})) AS i FROM d)
),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows SEMI JOIN again USING (w)),
places AS (
  SELECT doc_id, substr(h, 2 * p + 1, 2) AS x, p
  FROM (SELECT *, unnest(range(0, length(h) // 2)) AS p FROM d)
),
marked AS (
  SELECT places.*, coalesce(p - hits.i < {suffixes.LENGTH}, false) AS gone
  FROM places ASOF LEFT JOIN hits ON places.doc_id = hits.doc_id AND places.p >= hits.i
),
edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens
  FROM marked
)
SELECT d.doc_id, count(x) AS n_bytes,
       CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
       CAST(coalesce(sum(CASE WHEN opens THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN edges ON edges.doc_id = d.doc_id
GROUP BY d.doc_id
"""


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table: junk has quality 0, toxic text is toxic and no junk."""
    name = (
        F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    )
    return labels.dropna(subset=["doc_id", "quality", "toxic"]).select(
        "doc_id", name.alias("domain")
    )


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of documents that give target shares of clean, toxic and junk tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, DOMAINS, keep=["doc_id"]).select(
        "doc_id",
        "n_tokens",
        *[F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS)],
        "rate",
        "copies",
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as images in archives, read back and described."""
    described = media.media_column(table(spark, sf_dir, "documents"))
    return described.select("doc_id", *media.DESCRIBED)


def fold(column: str):
    """The fold of an id; a null id counts as empty text. It is in fold 0 and teaches nothing."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents, learned from labels outside the fold that is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id") != 0)
    scored = quality.score_quality(docs, labels, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents outside passages of 35 words that start more than once."""
    docs = table(spark, sf_dir, "documents")
    found = anchors.repeated_passages(deal.distinct_texts(docs))
    digest = _digest("kept").alias("kept_sha256")
    found = found.select("k1", "k2", "n_words", "n_removed", digest)
    return _for_documents(docs, found, "passage-digests")


OP5_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + {anchors.WINDOW - 1}], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(words) - {anchors.WINDOW - 2})) AS i FROM w)
),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows SEMI JOIN again USING (h)),
places AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
),
marked AS (
  SELECT places.*, coalesce(p - hits.i < {anchors.WINDOW}, false) AS gone
  FROM places ASOF LEFT JOIN hits ON places.doc_id = hits.doc_id AND places.p >= hits.i
)
SELECT w.doc_id, count(word) AS n_words,
       CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN marked ON marked.doc_id = w.doc_id
GROUP BY w.doc_id
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sources, but for their first place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cut = lines.remove_widespread_lines(docs)
    return cut.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP6_SQL = f"""
WITH l AS (
  SELECT doc_id, source, u.number, u.line
  FROM (SELECT doc_id, coalesce(source, '') AS source,
               string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS line, unnest(range(len(parts))) AS number) u
),
wide AS (
  SELECT line, min((doc_id, number)) AS first FROM l
  WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {lines.MIN_SITES}
),
marked AS (
  SELECT l.*, w.line IS NOT NULL AND (l.doc_id, l.number) <> w.first AS gone
  FROM l LEFT JOIN wide w ON l.line = w.line
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest embeddings of each embedding whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_dot_product(q.e, v.e)
           / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles overlap by 80 in 100."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - 3),
                                         lambda i: array_to_string(words[i : i + 4], ' '))) AS shingle
    FROM w WHERE len(words) >= 5
    UNION ALL
    SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
),
edges AS (
  SELECT x, y FROM links JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)
),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sizes
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(reach.y), w.doc_id) AS component_id
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN reach ON reach.x = w.doc_id
GROUP BY w.doc_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, counted on the whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.section_counts(docs)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents, learned from labels outside the fold that is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id") != 0)
    scored = toxicity.score_toxicity(docs, labels, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of each embedding whose id is divisible by 100; every
    seventh label is moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({hardneg.SCALE} * x)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same,
         CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {hardneg.POSITIVES}
),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                            ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 100 * s.score BETWEEN {hardneg.LOW} * p.positive_score AND {hardneg.HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {hardneg.NEGATIVES}
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their near words; every 31st run or so has a slip."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slips=31)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    query.__name__: query
    for query in (
        op1_suffix_array_dedup, op2_soft_mixing, op3_media_columns, op4_quality_classifier,
        op5_substring_dedup, op6_line_dedup, op7_nearest_vectors, op8_jaccard_join,
        op9_token_counts, op10_bpe, op11_toxicity, op12_hard_negatives, op13_spelling_variants,
        pipeline,
    )
}

SQL = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_nearest_vectors": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op12_hard_negatives": OP12_SQL,
}
