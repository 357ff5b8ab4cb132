"""The queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """A public tokenizer file, where every executor has the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), 24)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096, 1)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), 75)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.pii import with_surrogates

    return with_surrogates(_read(spark, sf_dir, "documents"), b"a key of the corpus owner")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.toxicity import fit_on, score_toxicity

    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_on(docs, _read(spark, sf_dir, "labels")), 0.3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.exactdedup import exact_groups

    return exact_groups(_read(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.tokenfiles import shared_folder, token_file_digest, write_token_files

    manifest = write_token_files(_read(spark, sf_dir, "documents"), shared_folder(spark), tokenizer_path("byte_bpe_50k.json"), 0)
    return token_file_digest(manifest)


#: Target shares of the tokens of good and of poor documents (labels.quality 1 and 0).
MIXTURE = {"1": 0.96, "0": 0.04}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sediment.llm.mixing import fit_rates

    found = fit_rates(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), MIXTURE, "quality", keep=("source",))
    low, high = (F.col("posteriors")[k] for k in range(2))
    return found.rows.select("doc_id", "source", "n_tokens", low.alias("p_poor"), high.alias("p_good"), "rate", "copies")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.langid import fit_on, identify

    docs = _read(spark, sf_dir, "documents")
    return identify(docs, fit_on(docs))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.collocations import collocations

    return collocations(_read(spark, sf_dir, "documents"), 2000)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.spelling import spelling_forms

    return spelling_forms(_read(spark, sf_dir, "documents"), 31)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sediment.llm.simhash import simhash_groups

    return simhash_groups(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_shards, op2_packing, op3_near_duplicates, op4_surrogates, op5_toxicity, op6_exact_dedup, op7_fingerprints, op8_token_files, op9_mixing, op10_language, op11_collocations, op12_spelling, op13_simhash)}

SQL: dict[str, str] = {
    "op3_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
""",
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM ws, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM ws GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (
  SELECT lang, f AS longer, unnest(flatten(list_transform(range(2, m), lambda x: list_transform(range(1, m - x + 2), lambda i: array_to_string(w[i:i + x - 1], ' '))))) AS phrase
  FROM f WHERE m > 2
), covers AS (SELECT lang, phrase, max(longer) AS longer FROM subs GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN covers USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
}
