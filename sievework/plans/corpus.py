"""Queries of scanning, filtering, hashing, dedup, contamination, splitting and rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import schema
from sievework.functions import sketch
from sievework.functions import text as t
from sievework.operators import dedup, filters, fim, splits, tokens
from sievework.plans.shared import FIRST, LIMIT, NORMAL, SOUND, documents, table
from sievework.sources import readers

_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_TOKENS = f"regexp_extract_all({NORMAL}, '[{_WORD}]+|[^{_WORD}\\s]')"
_GRAMS = "CASE WHEN len(k) >= 3 THEN list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i + 2], chr(31))) ELSE k END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus that later queries start from: sound first copies with their split."""
    return splits.split_documents(dedup.first_copies(documents(spark, sf_dir)), 0.1)


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tokens.byte_count(F.col("text")) + 1
    sums = first_copies(spark, sf_dir).groupBy("split").agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"))
    return sums.select("split", "documents", "tokens", F.ceil(F.col("tokens") / LIMIT).alias("sequences"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))


def normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.normalized_hash(F.col("text")).alias("norm_hash"))


def eval_normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", t.evaluation_hash(F.col("text")).alias("eval_hash"))


def structural_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", filters.structural_reason(F.col("text")).alias("reason"))


def structural_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.reason_counts(structural_filter(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records; what the table lacks follows from the id, so that every rule of the chain meets some row."""
    i = F.col("doc_id")
    path = F.when(i % 7 == 0, None).when(i % 7 == 1, F.concat(F.lit("src/vendor/m"), i, F.lit(".py"))).when(i % 7 == 2, F.concat(F.lit("Dist\\m"), i, F.lit(".py"))).otherwise(F.concat(F.lit("src/m"), i, F.lit(".py")))
    rows = readers.from_table(table(spark, sf_dir, "documents"), "r1", "MIT").withColumn("doc_id", F.col("ord"))
    return rows.withColumns({"path": path, "license": F.when(i % 5 == 0, "GPL-3.0").otherwise("MIT"), "source_type": F.when(i % 11 == 0, "text").otherwise("code"), "source": F.when(i % 13 == 0, " ").otherwise(F.col("source"))})


_RECORDS = r"""records AS (
    SELECT doc_id, text, lang, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'src/vendor/m' || doc_id || '.py'
             WHEN doc_id % 7 = 2 THEN 'Dist\m' || doc_id || '.py' ELSE 'src/m' || doc_id || '.py' END AS path,
           CASE WHEN doc_id % 5 = 0 THEN 'GPL-3.0' ELSE 'MIT' END AS license,
           CASE WHEN doc_id % 11 = 0 THEN 'text' ELSE 'code' END AS source_type,
           CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE source END AS source FROM documents)"""
_LINES = f"""(SELECT doc_id, CASE WHEN len(ls) = 0 THEN [text] ELSE ls END AS ls FROM (
    SELECT doc_id, text, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT doc_id, text, string_split_regex(text, '{t.BREAK}') AS ls FROM documents)))"""
_SHAPE = f"""shape AS (SELECT doc_id, list_max(list_transform(ls, lambda x: length(x)))::INT AS longest,
    list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) AS mean FROM {_LINES})"""
_SECRET = " OR ".join(f"regexp_matches(text, {_quoted(p)})" for p in (t.KEY_BLOCK, t.CLOUD_KEY, t.QUOTED_SECRET))
_PERSONAL = f"regexp_matches(text, {_quoted(t.EMAIL)}) OR regexp_matches(text, {_quoted(t.PHONE_PLAIN)})"
_LICENCES = ", ".join(f"'{x}'" for x in schema.LICENCES)
_CODE = f"""{_RECORDS}, {_SHAPE}, judged AS (
    SELECT doc_id, CASE WHEN source_type <> 'code' THEN 'not_code' WHEN coalesce(path, '') = '' THEN 'missing_path'
      WHEN license NOT IN ({_LICENCES}) THEN 'license' WHEN length(text) NOT BETWEEN 32 AND 1000000 THEN 'character_bounds'
      WHEN NOT regexp_matches(text, '{t.NOT_SPACE}') OR instr(text, chr(0)) > 0 THEN 'binary_or_empty'
      WHEN list_has_any(string_split_regex(lower(path), '[/\\\\]+'), ['build', 'dist', 'node_modules', 'third_party', 'vendor']) THEN 'vendor_or_generated_path'
      WHEN {" OR ".join(f"contains(lower(left(text, 2000)), '{g}')" for g in t.GENERATED)} THEN 'generated'
      WHEN {_SECRET} THEN 'secret_or_credential' WHEN {_PERSONAL} THEN 'personal_data'
      WHEN longest > 2000 OR mean > 300 THEN 'minified_or_malformed' END AS reason
    FROM records JOIN shape USING (doc_id))"""


def provenance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", filters.provenance_violation().alias("violation"))


def code_rejection_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", filters.code_reason().alias("reason"))


def code_admission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_code(_records(spark, sf_dir))[1]


def pii_secret_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.has_secret(F.col("text")).alias("secret"), t.has_personal_data(F.col("text")).alias("personal"))


def line_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest, mean = filters.line_shape(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", longest.alias("longest"), mean.alias("mean"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    barred = table(spark, sf_dir, "benchmark").select(t.content_hash(F.col("text")).alias("content_hash"))
    return dedup.first_copies(documents(spark, sf_dir), excluded=barred).select("doc_id", "content_hash")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = t.content_hash(F.col("text"))
    bucket = splits.split_bucket(h)
    return documents(spark, sf_dir).select("doc_id", bucket.alias("bucket"), splits.split_name(bucket).alias("split"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_copies(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("distinct_contents"))


def corpus_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.corpus_identity(documents(spark, sf_dir).withColumn("content_hash", t.content_hash(F.col("text"))))


def fim_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.lineage(_records(spark, sf_dir), 0.15, 19).select("doc_id", "fim", "record_id", "parent_content_hash")


def fim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.counts(fim.lineage(_records(spark, sf_dir), 0.15, 19))


def fim_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.mix(_records(spark, sf_dir), 0.15, 19).select("doc_id", "record_id", "content_hash", "parent_content_hash", "transform", F.length("text").alias("characters"))


def word_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", t.words(F.col("text")).alias("w")).withColumn("g", t.shingles(F.col("w")))
    return rows.select("doc_id", F.size("w").alias("tokens"), F.size("g").alias("shingles"), F.sha2(F.array_join("g", "|"), 256).alias("shingle_hash"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.simhash_sha(documents(spark, sf_dir), "doc_id", "text")


def simhash_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("doc_id", sketch.hex16(F.col("signature")).alias("signature"))


def simhash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", sketch.hex16(sketch.simhash_blake2b("text")).alias("signature"))


def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("doc_id", F.posexplode(sketch.bands(F.col("signature"))).alias("band", "value"))


def near_pairs_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_signatures(_signed(spark, sf_dir), 3)


def _evaluation(spark: SparkSession, sf_dir: str, hashing: str) -> DataFrame:
    return dedup.signatures(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "ord"), hashing=hashing)


def admission_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.admit(documents(spark, sf_dir), hashing="sha", evaluation=_evaluation(spark, sf_dir, "sha")).withColumnRenamed("ord", "doc_id")


def admission_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.admit(documents(spark, sf_dir), evaluation=_evaluation(spark, sf_dir, "blake2b")).withColumnRenamed("ord", "doc_id")


def admission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.reason_counts(admission_blake2b(spark, sf_dir))


def signature_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands table of the signature index over all documents, by the JVM's hash."""
    return dedup.signature_index(dedup.signatures(documents(spark, sf_dir), hashing="sha"))[1].groupBy("band").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


def eval_exact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = dedup.evaluation_overlap(dedup.signatures(documents(spark, sf_dir), hashing="sha"), _evaluation(spark, sf_dir, "sha"), 3)
    return signed.select(F.col("ord").alias("doc_id"), "eval_exact")


def eval_near_overlap_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = dedup.evaluation_overlap(dedup.signatures(documents(spark, sf_dir), hashing="sha"), _evaluation(spark, sf_dir, "sha"), 8)
    return signed.select(F.col("ord").alias("doc_id"), "eval_near")


def contamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as fixtures against documents: the prompt is an item's text, the reference its first line."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"), F.element_at(F.split("text", "\n"), 1).alias("reference"))
    report = dedup.contamination(items, documents(spark, sf_dir), hashing="sha")
    return report.select(F.array_join("exact_ids", ",").alias("exact_ids"), F.array_join("near_ids", ",").alias("near_ids"), "clean")


def pretoken_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pre_token_histogram(documents(spark, sf_dir))


def paragraph_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.paragraphs(documents(spark, sf_dir)).select(F.col("ord").alias("doc_id"), "at", t.content_hash(F.col("text")).alias("content_hash"))


def snapshot_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read cursor's feature is a limit: 50 rows from the 20th on."""
    return readers.read_snapshot(spark, f"{sf_dir}/documents.parquet", revision="r1", license="ODC-BY-1.0", start=20, limit=50).select("ord", "record_id", "language", "license")


def _signature_sql(source: str = "documents", key: str = "doc_id") -> str:
    votes = ", ".join(f"sum(CASE WHEN (v >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64))
    total = " + ".join(f"CASE WHEN b{b} >= 0 THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
    return f"""(WITH w AS (SELECT {key}, {_TOKENS} AS k FROM {source}),
      v AS (SELECT {key}, ('0x' || substr(sha256(g), 1, 16))::UBIGINT AS v FROM (SELECT {key}, unnest({_GRAMS}) AS g FROM w)),
      s AS (SELECT {key}, {votes} FROM v GROUP BY {key}),
      u AS (SELECT {key}, coalesce({total}, 18446744073709551615) AS u FROM {source} LEFT JOIN s USING ({key}))
      SELECT {key}, CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END::BIGINT AS signature, lpad(lower(to_hex(u::UBIGINT)), 16, '0') AS digits FROM u)"""


def _bands_sql(signature: str, count: int) -> str:
    edges = [round(64 * i / count) for i in range(count + 1)]
    # Bits are taken from the hex digits' unsigned value, for SQL's shifts of negative numbers differ.
    u = f"(CASE WHEN {signature} < 0 THEN {signature}::HUGEINT + 18446744073709551616 ELSE {signature} END)::UBIGINT"
    return "[" + ", ".join(f"(({u} >> {a}) & {(1 << (b - a)) - 1})::BIGINT" for a, b in zip(edges[:-1], edges[1:])) + "]"


_DISTANCE = "bit_count(xor(a, b))::INT"
_EVAL_STRIP = f"regexp_replace(text, '^{t.SPACE}+|{t.SPACE}+\\z', '', 'g')"


def _eval_hash_sql() -> str:
    return f"sha256(array_to_string(list_transform(string_split_regex({_EVAL_STRIP}, '{t.BREAK}'), lambda x: regexp_replace(x, '{t.SPACE}+\\z', '')), chr(10)) || chr(10))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        corpus_summary, content_hash, normalized_hash, eval_normalized_hash, structural_filter, structural_counts, provenance_violations, code_rejection_reason, code_admission_counts, pii_secret_flags,
        line_shape, exact_dedup, hash_split, split_counts, corpus_identity, fim_lineage, fim_counts, fim_rendered, word_shingles, simhash_sql, simhash_blake2b, lsh_bands, near_pairs_sql, admission_sha,
        admission_blake2b, admission_counts, signature_bands, eval_exact_overlap, eval_near_overlap_sql, contamination_report, pretoken_histogram, paragraph_source, snapshot_cursor,
    )
}

_BUCKET = "('0x' || substr(sha256(text), 1, 8))::BIGINT % 10000"
_FIM = f"""{_RECORDS}, marked AS (SELECT *, source_type = 'code' AND length(text) >= 3 AND substr(sha256('fim:19:' || sha256(text)), 1, 16) < '{int(0.15 * (1 << 64)):016x}' AS fim FROM records)"""

SQL: dict[str, str] = {
    "corpus_summary": f"WITH {FIRST} SELECT split, count(*) AS documents, sum(n)::BIGINT AS tokens, ceil(sum(n) / {LIMIT})::BIGINT AS sequences FROM placed GROUP BY split",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "normalized_hash": f"SELECT doc_id, sha256({NORMAL}) AS norm_hash FROM documents",
    "eval_normalized_hash": f"SELECT item_id, {_eval_hash_sql()} AS eval_hash FROM benchmark",
    "structural_filter": f"SELECT doc_id, CASE WHEN length(text) NOT BETWEEN 32 AND 1000000 THEN 'character_bounds' WHEN NOT ({SOUND}) THEN 'malformed' END AS reason FROM documents",
    "structural_counts": f"SELECT coalesce(CASE WHEN length(text) NOT BETWEEN 32 AND 1000000 THEN 'character_bounds' WHEN NOT ({SOUND}) THEN 'malformed' END, 'admitted') AS reason, count(*) AS n FROM documents GROUP BY 1",
    "provenance_violations": f"""WITH {_RECORDS} SELECT doc_id, CASE WHEN trim(coalesce(source, '')) = '' THEN 'missing: source'
        WHEN source_type = 'code' AND license NOT IN ({_LICENCES}) THEN 'license' END AS violation FROM records""",
    "code_rejection_reason": f"WITH {_CODE} SELECT doc_id, reason FROM judged",
    "code_admission_counts": f"WITH {_CODE} SELECT coalesce(reason, 'admitted') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "pii_secret_flags": f"SELECT doc_id, ({_SECRET}) AS secret, ({_PERSONAL}) AS personal FROM documents",
    "line_shape": f"WITH {_SHAPE} SELECT doc_id, longest, mean FROM shape",
    "exact_dedup": f"""SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE {SOUND} AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)
        QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""",
    "hash_split": f"SELECT doc_id, {_BUCKET} AS bucket, CASE WHEN {_BUCKET} < 100 THEN 'validation' ELSE 'train' END AS split FROM documents",
    "split_counts": f"WITH {FIRST} SELECT split, count(*) AS n, count(DISTINCT h) AS distinct_contents FROM placed GROUP BY split",
    "corpus_identity": "SELECT sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS identity, count(*) AS documents FROM documents",
    "fim_lineage": f"""WITH {_FIM} SELECT doc_id, fim, CASE WHEN fim THEN doc_id || ':fim:{schema.FIM_VERSION}' ELSE doc_id::VARCHAR END AS record_id,
        CASE WHEN fim THEN sha256(text) END AS parent_content_hash FROM marked""",
    "fim_counts": f"WITH {_FIM} SELECT count(*) AS total, count(*) FILTER (fim) AS transformed FROM marked",
    "word_shingles": f"""SELECT doc_id, len(k)::INT AS tokens, len(g)::INT AS shingles, sha256(array_to_string(g, '|')) AS shingle_hash
        FROM (SELECT doc_id, k, {_GRAMS} AS g FROM (SELECT doc_id, {_TOKENS} AS k FROM documents))""",
    "simhash_sql": f"SELECT doc_id, digits AS signature FROM {_signature_sql()}",
    "lsh_bands": f"SELECT doc_id, (generate_subscripts(x, 1) - 1)::INT AS band, unnest(x) AS value FROM (SELECT doc_id, {_bands_sql('signature', 4)} AS x FROM {_signature_sql()})",
    "near_pairs_sql": f"""WITH s AS (SELECT DISTINCT signature FROM {_signature_sql()}),
        x AS (SELECT signature, unnest(range(4)) AS band, unnest({_bands_sql('signature', 4)}) AS value FROM s)
        SELECT DISTINCT a, b, {_DISTANCE} AS distance FROM (SELECT l.signature AS a, r.signature AS b FROM x l JOIN x r USING (band, value) WHERE l.signature < r.signature) WHERE {_DISTANCE} <= 3""",
    "signature_bands": f"""SELECT band, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (
        SELECT signature, unnest(range(4))::INT AS band, unnest({_bands_sql('signature', 4)}) AS value FROM (SELECT DISTINCT signature FROM {_signature_sql()})) GROUP BY band""",
    "eval_exact_overlap": f"SELECT doc_id, sha256({NORMAL}) IN (SELECT sha256({NORMAL}) FROM benchmark) AS eval_exact FROM documents",
    "eval_near_overlap_sql": f"""WITH e AS (SELECT signature AS b FROM {_signature_sql('benchmark', 'item_id')}), d AS (SELECT doc_id, signature AS a FROM {_signature_sql()})
        SELECT doc_id, EXISTS (SELECT 1 FROM e WHERE {_DISTANCE} <= 8) AS eval_near FROM d""",
    "contamination_report": f"""WITH p AS (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id, string_split(text, chr(10))[1] FROM benchmark),
        q AS (SELECT row_number() OVER () AS n, * FROM p),
        x AS (SELECT DISTINCT item_id FROM p WHERE {_eval_hash_sql()} IN (SELECT {_eval_hash_sql()} FROM documents)),
        y AS (SELECT DISTINCT item_id FROM q JOIN (SELECT n, signature AS a FROM {_signature_sql('q', 'n')}) USING (n)
              WHERE EXISTS (SELECT 1 FROM (SELECT signature AS b FROM {_signature_sql()}) WHERE {_DISTANCE} <= 3))
        SELECT (SELECT coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') FROM x) AS exact_ids, (SELECT coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') FROM y) AS near_ids,
               NOT EXISTS (FROM x) AND NOT EXISTS (FROM y) AS clean""",
    "paragraph_source": f"""SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS at, sha256(unnest(p)) AS content_hash FROM (
        SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^{t.SPACE}+|{t.SPACE}+\\z', '', 'g')), lambda x: length(x) >= 64) AS p FROM documents)""",
    "snapshot_cursor": "SELECT doc_id AS ord, doc_id::VARCHAR AS record_id, coalesce(lang, 'unknown') AS language, 'ODC-BY-1.0' AS license FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20",
}
