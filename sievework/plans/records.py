"""Queries of evaluation, gates and numerics. Small record tables are written out; the rest reads the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import numerics
from sievework.operators import evaluate, gates
from sievework.plans.shared import table

_CONFIGS = """(VALUES
    ('a', 'edu', 16384, 2048, 12, 512, 8, 8, 1536, 1e-5D, 10000.0D, false, 'full', 256, 'rope', 0.0D, 'auto'),
    ('b', 'modern', 32000, 4096, 24, 1024, 16, 4, 2816, 1e-5D, 500000.0D, true, 'hybrid', 512, 'none', 0.0D, 'flex'),
    ('c', 'modern', 32000, 4096, 22, 1040, 16, 16, 0, 0.0D, 10000.0D, true, 'hybrid', 8192, 'rope', 0.1D, 'auto'),
    ('d', 'other', 100, 64, 3, 90, 6, 4, 128, 1e-5D, -1.0D, true, 'full', 32, 'none', 1.0D, 'odd'))
    AS t(name, preset, vocab_size, max_seq_len, n_layers, d_model, n_heads, n_kv_heads, d_ff, norm_eps, rope_theta, qk_norm, attention_pattern, local_window, global_position_encoding, dropout, attention_impl)"""
_RUNS = """(VALUES ('a', 100, 10, 3e-4D, 3e-5D, 0.9D, 0.95D, 0.1D, 1.0D, 4, 20), ('b', 0, 0, 0.0D, 0.0D, 0.9D, 0.95D, 0.1D, 1.0D, 1, 0), ('c', 10, 10, 1e-4D, 1e-3D, 1.0D, 0.95D, -0.1D, 0.0D, 0, -1))
    AS t(name, updates, warmup, rate, least_rate, beta1, beta2, decay, clip, accumulation, "interval")"""
_PROTOCOLS = """(VALUES ('a', 'draft', 1000000, 4096, 1024, 100, 3e-4D, 3, 'x', 'mix', 'adamw', 0, false), ('b', 'frozen', 1000000, 4096, 1024, 100, 3e-4D, 3, 'x', 'mix', 'adamw', 2, false),
    ('c', 'frozen', 4000000000, 4096, 1024, 100, 3e-4D, 3, 'x', 'mix', 'adamw', 2, false), ('d', 'frozen', 4000000000, 4096, 1024, 100, 3e-4D, 3, 'x', 'mix', 'adamw', 0, false),
    ('e', 'draft', 1000000, 0, 1024, 100, 3e-4D, 3, 'x', 'mix', 'adamw', 0, false), ('f', 'open', 1000000, 4096, 1024, 100, 3e-4D, 0, 'x', 'mix', 'adamw', 0, true), ('g', 'draft', 1000000, 4096, 1024, 100, 3e-4D, 1, 'x', '', 'adamw', 0, true))
    AS t(name, status, target_tokens, batch_tokens, sequence_length, evaluation_interval, learning_rate, seeds, tokenizer_sha256, data_mixture_id, optimizer, evidence, approved)"""
_SCALES = """(VALUES ('a', 'cuda', 'completed', 0.8D, 3.0D, 0, 0, 40, 900.0D, 9.1D, 6.0D, true, 'high'), ('b', 'cuda', 'completed', 0.99D, 30.0D, 2, 1, 5, 0.0D, 6.0D, 6.0D, false, 'low'),
    ('c', 'cpu', 'completed', 0.1D, 1.0D, 0, 0, 40, 900.0D, 9.1D, 6.0D, true, 'high'), ('d', 'cuda', 'running', 0.1D, 1.0D, 0, 0, 40, 900.0D, 9.1D, 6.0D, true, 'high'))
    AS t(name, device, status, memory, hours, failures, nonfinite, updates, tokens_per_second, loss_start, loss_end, resumed, learning_value)"""
_RECORDS = """(VALUES ('edu', 'd1', 'h', 1000, 10, 64, 'fixed', 'e1', 'loss', 6.5D), ('edu', 'd1', 'h', 1000, 10, 64, 'fixed', 'e1', 'bpb', 2.0D), ('modern', 'd1', 'h', 1000, 10, 64, 'fixed', 'e1', 'loss', 6.25D),
    ('modern', 'd1', 'h', 1000, 10, 64, 'fixed', 'e1', 'accuracy', 0.5D), ('modern', 'd2', 'h', 1000, 10, 64, 'fixed', 'e1', 'bpb', 1.0D))
    AS t(arm, data_id, tokenizer_hash, token_budget, batch_tokens, context_length, seed_policy, evaluation_id, metric, value)"""


def _values(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + text.replace('"interval"', "interval"))


def _duck(text: str) -> str:
    """The same rows for an engine whose numbers have no D mark."""
    import re

    return re.sub(r"(?<=[0-9])D\b", "::DOUBLE", text)


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as fixtures: the prompt is the text's first half, the reference the rest; every third prediction lacks its last character."""
    i, n = F.col("item_id"), F.length("text")
    half = F.floor(n / 2).cast("int")
    rest = F.substring("text", half + 1, n)
    kind = F.when(i % 3 == 0, "fim").when(i % 3 == 1, "syntax_repair").otherwise("completion")
    guess = F.when(i % 3 == 2, F.substring(rest, F.lit(1), n - half - 1)).otherwise(rest)
    return table(spark, sf_dir, "benchmark").select(i.alias("id"), kind.alias("kind"), F.substring("text", F.lit(1), half).alias("prompt"), rest.alias("reference"), guess.alias("prediction"), F.when(i % 3 == 0, "\n# end").alias("suffix"))


_FIXTURES = """f AS (SELECT item_id AS id, CASE item_id % 3 WHEN 0 THEN 'fim' WHEN 1 THEN 'syntax_repair' ELSE 'completion' END AS kind, left(text, length(text) // 2) AS prompt, substr(text, length(text) // 2 + 1) AS reference,
    CASE WHEN item_id % 3 = 2 THEN substr(text, length(text) // 2 + 1, length(text) - length(text) // 2 - 1) ELSE substr(text, length(text) // 2 + 1) END AS prediction, CASE WHEN item_id % 3 = 0 THEN chr(10) || '# end' ELSE '' END AS suffix FROM benchmark)"""


def fixture_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    made = evaluate.candidate(c("kind"), c("prompt"), c("prediction"), c("suffix"))
    return _fixtures(spark, sf_dir).select("id", F.sha2(made, 256).alias("candidate_hash"), (c("prediction") == c("reference")).alias("exact"))


def code_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixtures(spark, sf_dir)
    return evaluate.score_fixtures(rows.drop("prediction"), rows.select("id", "prediction"))


def code_score_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as scores: quality for exact, toxic for parses and compiles; the functional one is known for even ids only."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("exact"), (F.col("toxic") == 0).alias("parses"), (F.col("toxic") == 0).alias("compiles"), F.when(i % 2 == 0, F.col("quality") == 1).alias("functional"))
    got = evaluate.rates(rows)
    return got.select("fixtures", *(F.round(c, 9).alias(c) for c in ("exact_rate", "syntax_rate", "compile_rate", "functional_rate")), "functional_scored")


def sft_response_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item requires its first and last word; the response is the document of its number, if there is one."""
    words = F.split("text", " ")
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array(F.element_at(words, 1), F.element_at(words, -1)).alias("required"))
    return evaluate.score_responses(prompts, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("response")))


def sft_response_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.response_rates(sft_response_scores(spark, sf_dir))
    return got.select("prompts", F.round("non_empty_rate", 9).alias("non_empty_rate"), F.round("match_rate", 9).alias("match_rate"))


def lm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of losses: each document has its words as targets, at a loss of the logarithm of its length."""
    size = F.size(F.split("text", " "))
    rows = table(spark, sf_dir, "documents").select("lang", (size * F.log(F.col("n_chars") + 2.0)).alias("nll"), size.alias("tokens"), F.octet_length("text").alias("bytes"))
    got = evaluate.language_metrics(rows, ["lang"])
    return got.select("lang", *(F.round(c, 6).alias(c) for c in ("cross_entropy", "perplexity", "bits_per_byte")), "tokens", "bytes")


def comparable_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, _RECORDS).withColumn("value", F.col("value").cast("double"))
    packed = rows.groupBy("arm", *evaluate.KEY).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("quality"))
    got = evaluate.deltas(packed.where("arm = 'edu'"), packed.where("arm = 'modern'"))
    return got.select("data_id", "metric", "delta", evaluate.claim_strength(F.lit(1)).alias("claim"))


def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _CONFIGS).select("name", F.array_join(gates.config_violations(), ",").alias("violations"))


def training_config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _RUNS).select("name", F.array_join(gates.training_violations(), ",").alias("violations"))


def protocol_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _PROTOCOLS).select("name", gates.protocol_violation().alias("violation"))


def scale_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision, reasons = gates.scale_decision()
    return _values(spark, _SCALES).select("name", decision.alias("decision"), F.array_join(reasons, ",").alias("reasons"))


def kv_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.cache_bytes(_values(spark, _CONFIGS), 1, 2048)


def parameter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = gates.parameters()
    return _values(spark, _CONFIGS).select("name", n.alias("parameters"), gates.training_bytes(n).alias("training_bytes"))


def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.attention_mask(spark, 256, 32)


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 1001).select(F.col("id").alias("step"), F.round(numerics.learning_rate(F.col("id"), 1000, 100, 1.0, 0.1), 9).alias("rate"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit"))
    return rows.withColumn("logit", F.round(F.col("logit").cast("double") * 10, 3))


_LOGITS = "l AS (SELECT vec_id, i::INT - 1 AS token, round(x::DOUBLE * 10, 3) AS logit FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def greedy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.greedy(_logits(spark, sf_dir), "vec_id")


def topk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.top_k(_logits(spark, sf_dir), "vec_id", 5).select("vec_id", "token", "logit")


def topp_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.top_p(_logits(spark, sf_dir), "vec_id", 0.9).select("vec_id", "token", F.round("probability", 9).alias("probability"))


def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(numerics.rms_norm(F.col("embedding"))).alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round("x", 6).alias("x"))


def rotary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(numerics.rotate(vector, F.col("vec_id"))).alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round("x", 6).alias("x"))


def attention_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector attends to those of its label."""
    rows = table(spark, sf_dir, "embeddings")
    got = numerics.attention(rows.select(F.col("vec_id").alias("q"), F.col("label").alias("part"), F.col("embedding").alias("vector")), rows.select(F.col("vec_id").alias("k"), F.col("label").alias("part"), F.col("embedding").alias("vector")), 0.125)
    return got.select("q", "k", F.round("weight", 6).alias("weight"))


def token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of each vector's logits is its number modulo 64."""
    logits = _logits(spark, sf_dir).select(F.lit(0).alias("seq_id"), F.col("vec_id").alias("pos"), "token", "logit")
    targets = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("seq_id"), F.col("vec_id").alias("pos"), (F.col("vec_id") % 64).cast("int").alias("target"))
    return numerics.token_loss(logits, targets).select("pos", F.round("nll", 6).alias("nll"))


def next_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numerics.counting_batch(spark, 32, 64, 50).select(F.col("i").alias("seq_id"), F.col("j").alias("pos"), "token")
    return numerics.next_tokens(rows)


def pattern_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerics.counting_batch(spark, 32, 64, 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fixture_candidates, code_scores, code_score_rates, sft_response_scores, sft_response_rates, lm_metrics, comparable_delta, config_violations, training_config_violations, protocol_gate, scale_decision,
        kv_bytes, parameter_count, attention_mask, lr_schedule, greedy_tokens, topk_tokens, topp_tokens, rms_norm, rotary, attention_embeddings, token_loss, next_tokens, pattern_batch,
    )
}


def _rules(source: str, rules: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules.items())
    return f"SELECT name, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS violations FROM {_duck(source)}"


_HEAD = "(d_model // n_heads)"
_ATTENTION = """s AS (SELECT a.vec_id AS q, b.vec_id AS k, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) * 0.125 AS s FROM embeddings a JOIN embeddings b USING (label)),
    e AS (SELECT q, k, exp(s - max(s) OVER (PARTITION BY q)) AS e FROM s)"""
_ROTARY = "cos(vec_id / pow(10000.0::DOUBLE, d * 2.0::DOUBLE / 64))", "sin(vec_id / pow(10000.0::DOUBLE, d * 2.0::DOUBLE / 64))"

SQL: dict[str, str] = {
    "fixture_candidates": f"WITH {_FIXTURES} SELECT id, sha256(CASE kind WHEN 'fim' THEN prompt || prediction || suffix WHEN 'syntax_repair' THEN prediction ELSE prompt || prediction END) AS candidate_hash, prediction = reference AS exact FROM f",
    "code_score_rates": """SELECT count(*) AS fixtures, round(avg((quality = 1)::INT), 9) AS exact_rate, round(avg((toxic = 0)::INT), 9) AS syntax_rate, round(avg((toxic = 0)::INT), 9) AS compile_rate,
        round(avg((quality = 1)::INT) FILTER (doc_id % 2 = 0), 9) AS functional_rate, count(*) FILTER (doc_id % 2 = 0 AND quality IS NOT NULL) AS functional_scored FROM labels""",
    "sft_response_scores": """SELECT item_id AS id, regexp_matches(coalesce(d.text, ''), '[^ \\t\\r\\n]') AS non_empty,
        contains(coalesce(d.text, ''), string_split(b.text, ' ')[1]) AND contains(coalesce(d.text, ''), string_split(b.text, ' ')[-1]) AS matched FROM benchmark b LEFT JOIN documents d ON item_id = doc_id""",
    "sft_response_rates": """SELECT count(*) AS prompts, round(count(*) FILTER (regexp_matches(coalesce(d.text, ''), '[^ \\t\\r\\n]')) / count(*), 9) AS non_empty_rate,
        round(count(*) FILTER (contains(coalesce(d.text, ''), string_split(b.text, ' ')[1]) AND contains(coalesce(d.text, ''), string_split(b.text, ' ')[-1])) / count(*), 9) AS match_rate FROM benchmark b LEFT JOIN documents d ON item_id = doc_id""",
    "lm_metrics": """SELECT lang, round(sum(nll) / sum(n), 6) AS cross_entropy, round(exp(sum(nll) / sum(n)), 6) AS perplexity, round(sum(nll) / (ln(2) * sum(b)), 6) AS bits_per_byte, sum(n)::BIGINT AS tokens, sum(b)::BIGINT AS bytes
        FROM (SELECT lang, len(string_split(text, ' ')) AS n, len(string_split(text, ' ')) * ln(n_chars + 2.0::DOUBLE) AS nll, strlen(text) AS b FROM documents) GROUP BY lang""",
    "comparable_delta": f"""WITH r AS (SELECT * FROM {_duck(_RECORDS)}) SELECT a.data_id, a.metric, b.value - a.value AS delta, 'exploratory' AS claim FROM r a JOIN r b
        ON (a.data_id, a.tokenizer_hash, a.token_budget, a.batch_tokens, a.context_length, a.seed_policy, a.evaluation_id, a.metric) = (b.data_id, b.tokenizer_hash, b.token_budget, b.batch_tokens, b.context_length, b.seed_policy, b.evaluation_id, b.metric)
        WHERE a.arm = 'edu' AND b.arm = 'modern'""",
    "config_violations": _rules(_CONFIGS, {
        **{f"{n}_positive": f"{n} <= 0" for n in ("vocab_size", "max_seq_len", "n_layers", "d_model", "n_heads", "n_kv_heads", "d_ff", "local_window")},
        "heads_divide_width": "d_model % n_heads <> 0", "kv_heads_divide_heads": "n_heads % n_kv_heads <> 0", "head_width_even": f"{_HEAD} % 2 <> 0", "norm_eps": "norm_eps <= 0", "rope_theta": "rope_theta <= 0",
        "dropout": "dropout < 0 OR dropout >= 1", "window_in_context": "local_window > max_seq_len",
        "edu": "preset = 'edu' AND (n_kv_heads <> n_heads OR qk_norm OR attention_pattern <> 'full' OR global_position_encoding <> 'rope')", "modern": "preset = 'modern' AND n_kv_heads >= n_heads",
        "no_positions": "global_position_encoding = 'none' AND attention_pattern <> 'hybrid'", "preset": "preset NOT IN ('edu', 'modern')", "pattern": "attention_pattern NOT IN ('full', 'hybrid')",
        "positions": "global_position_encoding NOT IN ('rope', 'none')", "implementation": "attention_impl NOT IN ('auto', 'flex', 'manual', 'sdpa')", "hybrid_dropout": "dropout > 0 AND attention_pattern = 'hybrid' AND attention_impl IN ('auto', 'flex')",
    }),
    "training_config_violations": _rules(_RUNS, {
        "updates": "updates <= 0", "warmup": "warmup < 0 OR warmup >= updates", "rate": "rate <= 0 OR least_rate < 0", "least_rate": "least_rate > rate", "betas": "NOT (beta1 >= 0 AND beta1 < 1 AND beta2 >= 0 AND beta2 < 1)",
        "decay_or_clip": "decay < 0 OR clip <= 0", "accumulation": "accumulation <= 0", "interval": '"interval" < 0',
    }),
    "protocol_gate": f"""SELECT name, CASE WHEN status NOT IN ('draft', 'frozen') THEN 'status' WHEN least(target_tokens, batch_tokens, sequence_length, evaluation_interval) <= 0 THEN 'not_positive'
        WHEN learning_rate <= 0 OR seeds = 0 THEN 'rate_or_seeds' WHEN tokenizer_sha256 = '' OR data_mixture_id = '' OR optimizer = '' THEN 'identity' WHEN status = 'frozen' AND evidence = 0 THEN 'no_evidence'
        WHEN status = 'frozen' AND target_tokens < 3000000000 AND NOT approved THEN 'small_budget' END AS violation FROM {_duck(_PROTOCOLS)}""",
    "scale_decision": f"""WITH r AS (SELECT *, list_filter([CASE WHEN memory > 0.95 THEN 'memory' END, CASE WHEN hours > 24 THEN 'hours' END, CASE WHEN failures > 1 THEN 'out_of_memory' END, CASE WHEN nonfinite > 0 THEN 'nonfinite' END,
        CASE WHEN updates < 20 THEN 'updates' END, CASE WHEN NOT resumed THEN 'resume' END, CASE WHEN loss_end >= loss_start THEN 'no_improvement' END, CASE WHEN tokens_per_second <= 0 THEN 'throughput' END,
        CASE WHEN learning_value = 'low' THEN 'learning_value' END], lambda x: x IS NOT NULL) AS why FROM {_duck(_SCALES)}),
        d AS (SELECT *, CASE WHEN device <> 'cuda' OR status <> 'completed' THEN 'invalid' WHEN len(why) = 0 THEN 'go' ELSE 'no_go' END AS decision FROM r)
        SELECT name, decision, CASE WHEN decision <> 'invalid' THEN array_to_string(why, ',') END AS reasons FROM d""",
    "kv_bytes": f"""SELECT name, sum(one * 2048)::BIGINT AS full_bytes, sum(one * CASE WHEN attention_pattern = 'hybrid' AND layer % 4 <> 3 THEN least(2048, local_window) ELSE 2048 END)::BIGINT AS bounded_bytes
        FROM (SELECT *, 4::BIGINT * n_kv_heads * {_HEAD} AS one, unnest(range(n_layers)) AS layer FROM {_duck(_CONFIGS)}) GROUP BY name""",
    "parameter_count": f"""SELECT name, p AS parameters, p * 12 AS training_bytes FROM (SELECT name, (vocab_size::BIGINT * d_model + n_layers * (d_model::BIGINT * (n_heads + n_kv_heads) * {_HEAD} * 2
        + d_model::BIGINT * d_ff * 3 + d_model * 2 + CASE WHEN qk_norm THEN {_HEAD} * 2 ELSE 0 END) + d_model)::BIGINT AS p FROM {_duck(_CONFIGS)})""",
    "attention_mask": "SELECT q, k FROM range(256) a(q), range(256) b(k) WHERE k <= q AND k >= q - 31",
    "lr_schedule": "SELECT s AS step, round(CASE WHEN s <= 100 THEN s * 0.01::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos((s - 101)::DOUBLE / 899 * pi())) END, 9) AS rate FROM range(1, 1001) t(s)",
    "greedy_tokens": f"WITH {_LOGITS} SELECT vec_id, token FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) = 1",
    "topk_tokens": f"WITH {_LOGITS} SELECT vec_id, token, logit FROM l QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 5",
    "topp_tokens": f"""WITH {_LOGITS}, w AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS w FROM l), p AS (SELECT vec_id, token, logit, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w)
        SELECT vec_id, token, round(p, 9) AS probability FROM p QUALIFY coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.9""",
    "rms_norm": """SELECT vec_id, d::INT - 1 AS dim, round(x / sqrt(m + 1e-5), 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d,
        list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) / len(embedding) AS m FROM embeddings)""",
    "rotary": f"""SELECT vec_id, d::INT AS dim, round(embedding[d + 1] * {_ROTARY[0]} - embedding[d + 33] * {_ROTARY[1]}, 6) AS x FROM embeddings, range(32) t(d)
        UNION ALL SELECT vec_id, d::INT + 32, round(embedding[d + 33] * {_ROTARY[0]} + embedding[d + 1] * {_ROTARY[1]}, 6) FROM embeddings, range(32) t(d)""",
    "attention_embeddings": f"WITH {_ATTENTION} SELECT q, k, round(e / sum(e) OVER (PARTITION BY q), 6) AS weight FROM e",
    "token_loss": f"""WITH {_LOGITS}, z AS (SELECT vec_id, max(logit) + ln(sum(exp(logit - m))) AS z FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS m FROM l) GROUP BY vec_id)
        SELECT vec_id AS pos, round(z - logit, 6) AS nll FROM l JOIN z USING (vec_id) WHERE token = vec_id % 64""",
    "next_tokens": "SELECT i AS seq_id, j::INT AS pos, (i % 49 + j) % 49 + 1 AS token, (i % 49 + j + 1) % 49 + 1 AS target FROM range(32) a(i), range(63) b(j)",
    "pattern_batch": "SELECT i, j::INT AS j, (i % 49 + j) % 49 + 1 AS token FROM range(32) a(i), range(64) b(j)",
}
