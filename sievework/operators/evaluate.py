"""Scores of predictions and responses, language-model metrics, and comparisons of benchmark records."""

from __future__ import annotations

import ast
import subprocess
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("data_id", "tokenizer_hash", "token_budget", "batch_tokens", "context_length", "seed_policy", "evaluation_id")


def candidate(kind: Column, prompt: Column, prediction: Column, suffix: Column) -> Column:
    """The source that a prediction makes, by the fixture's kind."""
    return F.when(kind == "fim", F.concat(prompt, prediction, F.coalesce(suffix, F.lit("")))).when(kind == "syntax_repair", prediction).otherwise(F.concat(prompt, prediction))


@F.pandas_udf(T.StructType([T.StructField(c, T.BooleanType()) for c in ("parses", "compiles")]))
def python_syntax(source: pd.Series) -> pd.DataFrame:
    """Whether a source parses, and compiles. Nothing is executed."""

    def both(text: str | None) -> tuple[bool, bool]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False, False
        try:
            compile(tree, "<candidate>", "exec")
        except (SyntaxError, ValueError, RecursionError):
            return True, False
        return True, True

    return pd.DataFrame([both(s) for s in source], columns=["parses", "compiles"])


def run_trusted(source: str, tests: str, *, trusted: bool = False, seconds: float = 2.0) -> bool | None:
    """Run a fixture's tests in a process of its own, on the driver; None unless the caller says that the fixture is trusted."""
    if not trusted:
        return None
    try:
        return subprocess.run([sys.executable, "-I", "-c", f"{source}\n{tests}"], timeout=seconds, capture_output=True, check=False).returncode == 0
    except subprocess.TimeoutExpired:
        return False


def score_fixtures(fixtures: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, exact, parses, compiles, functional) of fixtures (id, kind, prompt, reference, suffix) and predictions (id, prediction). A fixture without a prediction fails the job.

    `functional` is false where the fixture has `tests` and the source doesn't parse, else null: run_trusted decides it, outside the executors.
    """
    joined = fixtures.join(predictions.select("id", "prediction"), "id", "left")
    got = F.when(F.col("prediction").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col("id").cast("string")))).otherwise(F.col("prediction"))
    made = joined.withColumn("made", candidate(F.col("kind"), F.col("prompt"), got, F.col("suffix")))
    scored = made.withColumn("s", python_syntax("made"))
    tested = (F.length("tests") > 0) if "tests" in fixtures.columns else F.lit(False)
    functional = F.when(tested & ~F.col("s.parses"), F.lit(False))
    return scored.select("id", (F.col("prediction") == F.col("reference")).alias("exact"), "s.parses", "s.compiles", functional.alias("functional"))


def rates(scores: DataFrame) -> DataFrame:
    """One row of rates; the functional one over those that were run, null where none was."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return scores.agg(F.count("*").alias("fixtures"), rate("exact").alias("exact_rate"), rate("parses").alias("syntax_rate"), rate("compiles").alias("compile_rate"), rate("functional").alias("functional_rate"), F.count("functional").alias("functional_scored"))


def score_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, non_empty, matched) of prompts (id, required) and responses (id, response); a missing response is empty."""
    from sievework.functions.text import NOT_SPACE

    joined = prompts.join(responses, "id", "left").withColumn("response", F.coalesce("response", F.lit("")))
    return joined.select("id", F.col("response").rlike(NOT_SPACE).alias("non_empty"), F.forall("required", lambda x: F.contains(F.col("response"), x)).alias("matched"))


def response_rates(scores: DataFrame) -> DataFrame:
    """One row; no responses give rates of 0."""
    share = lambda c: F.coalesce(F.count_if(F.col(c)), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))
    return scores.agg(F.count("*").alias("prompts"), share("non_empty").alias("non_empty_rate"), share("matched").alias("match_rate"))


def language_metrics(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cross-entropy, perplexity and bits per byte from sums of (nll, tokens, bytes); ratios of sums, never means of means. Nothing to divide by fails."""
    sums = losses.groupBy(*(by or [])).agg(F.sum("nll").alias("nll"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    safe = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, F.raise_error(F.lit(f"no {c}")).cast("double")).otherwise(F.col(c).cast("double"))
    loss = F.col("nll") / safe("tokens")
    return sums.select(*(by or []), loss.alias("cross_entropy"), F.exp(loss).alias("perplexity"), (F.col("nll") / (F.log(F.lit(2.0)) * safe("bytes"))).alias("bits_per_byte"), "tokens", "bytes")


def key_violation() -> Column:
    """The first broken rule of a comparison key, or null."""
    out = F.lit(None).cast("string")
    for name in KEY:
        bad = F.coalesce(F.col(name).cast("long"), F.lit(0)) <= 0 if name in ("token_budget", "batch_tokens", "context_length") else F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
        out = F.coalesce(out, F.when(bad, F.lit(name)))
    return out


def deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """(KEY, metric, delta): right minus left of the metrics (map `quality`) that comparable records share; records are comparable if the whole key is equal."""
    each = lambda df, name: df.select(*KEY, F.explode("quality").alias("metric", name))
    return each(left, "a").join(each(right, "b"), [*KEY, "metric"]).select(*KEY, "metric", (F.col("b") - F.col("a")).alias("delta"))


def claim_strength(seeds: Column) -> Column:
    return F.when(seeds >= 3, "causal").otherwise("exploratory")


def equal_budgets(arms: DataFrame, column: str = "tokens") -> DataFrame:
    """One row: whether all arms of an experiment had one budget."""
    return arms.agg((F.count_distinct(column) == 1).alias("equal_budget"), F.count("*").alias("arms"))


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """The text before the earliest stop string."""
    first = F.least(*(F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops)) if len(stops) > 1 else F.when(F.instr(text, stops[0]) > 0, F.instr(text, stops[0]))
    return F.substring(text, F.lit(1), F.coalesce(first - 1, F.length(text)))
