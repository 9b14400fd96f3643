"""The operators' queries over whole tables, each with the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, fingerprints, forest, fuzzy_lines, mixing, packing, quality, substrings, surrogates, tiles, token_files, toxicity, whitening
from .common import documents


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.grouped_documents(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_copies(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


#: The query's key; a user of the operator has one of their own, and keeps it secret.
SURROGATE_KEY = b"a key for the query over test data"


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = fuzzy_lines.deduplicated(documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    rows = token_files.read(files, F.crc32("ids").alias("ids_crc32"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.grouped_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(documents(spark, sf_dir), SURROGATE_KEY).select("doc_id", "text", "n_replaced")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.deduplicated(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compared(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.printed(F.col("sketch")).alias("fingerprint"),
        fingerprints.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_count(F.col("sketch")).alias("n_shingles"),
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_fuzzy_lines": op1_fuzzy_lines,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_tiles": op4_tiles,
    "op5_surrogates": op5_surrogates,
    "op6_packing": op6_packing,
    "op7_substrings": op7_substrings,
    "op8_fingerprints": op8_fingerprints,
    "op9_forest": op9_forest,
    "op10_mixing": op10_mixing,
    "op11_quality": op11_quality,
    "op12_codes": op12_codes,
    "op13_whitening": op13_whitening,
}

#: What links reach, from edges(a, b) and all nodes(id): a row (id, component) for each node.
_REACHED = """
edge AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
least AS (SELECT id, min(other) AS other FROM reach GROUP BY id)"""

OP4_SQL = f"""
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM given
    WHERE len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_max([abs(x) FOR x IN v]) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    AND list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9), {_REACHED},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.other, vec_id)) AS component_id,
    least(vec_id, coalesce(least.other, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.id LEFT JOIN n ON vec_id = n.a"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
windows AS (SELECT doc_id, start, ws[start : start + 19] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS start FROM w)),
numbered AS (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS pos FROM numbered WHERE n > 1),
stays AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN stays USING (doc_id)"""

OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, ws[start : start + 3] AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, CASE WHEN len(ws) > 0 THEN 2 ELSE 0 END))) AS start FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * met.n >= 80 * (x.n + y.n - met.n)), {_REACHED}
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, least(doc_id, coalesce(least.other, doc_id)) AS component_id,
    least(doc_id, coalesce(least.other, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON doc_id = least.id"""

_ASSIGN = """
a{n} AS (SELECT vec_id, p, CAST(floor(k / 64) AS BIGINT) AS d, CAST(k - 64 * floor(k / 64) AS BIGINT) AS e FROM (
    SELECT vec_id, p, min(64 * (list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)) + e) AS k
    FROM part JOIN c{n} USING (p) GROUP BY vec_id, p))"""
_UPDATE = """
m{n} AS (SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, e, i, floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS m
    FROM a{o} JOIN part USING (vec_id, p), range(1, CAST((SELECT max(len(x)) FROM part) AS INTEGER) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e),
c{n} AS (SELECT p, e, coalesce(m, c) AS c FROM c{o} LEFT JOIN m{n} USING (p, e))"""

OP12_SQL = f"""
WITH v AS (SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
part AS (SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM v, range(16) t(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_ASSIGN.format(n=0)}, {_UPDATE.format(n=1, o=0)}, {_ASSIGN.format(n=1)}, {_UPDATE.format(n=2, o=1)}, {_ASSIGN.format(n=2)},
book AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM c2)),
code AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM code JOIN v USING (vec_id), book"""

ORACLES: dict[str, str] = {"op12_codes": OP12_SQL, "op4_tiles": OP4_SQL, "op7_substrings": OP7_SQL, "op9_forest": OP9_SQL}
