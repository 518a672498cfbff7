"""Go and no-go rules over record tables: every rule is a column, so a table of a million records is one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(**rules: Column) -> Column:
    """array<string>: the names of the rules that are broken (true)."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items())))


def config_violations() -> Column:
    """Rules of a model's dimensions and of its preset: edu is plain multi-head attention with rotary positions everywhere, modern shares key heads."""
    c = F.col
    sizes = ("vocab_size", "max_seq_len", "n_layers", "d_model", "n_heads", "n_kv_heads", "d_ff", "local_window")
    positive = {f"{n}_positive": c(n) <= 0 for n in sizes}
    by_heads = lambda x: F.when(c("n_heads") > 0, x)
    edu, hybrid = c("preset") == "edu", c("attention_pattern") == "hybrid"
    return violations(
        **positive,
        heads_divide_width=F.coalesce(by_heads(c("d_model") % F.greatest(c("n_heads"), F.lit(1)) != 0), F.lit(False)),
        kv_heads_divide_heads=F.coalesce(F.when(c("n_kv_heads") > 0, c("n_heads") % F.greatest(c("n_kv_heads"), F.lit(1)) != 0), F.lit(False)),
        head_width_even=F.coalesce(by_heads(F.floor(c("d_model") / F.greatest(c("n_heads"), F.lit(1))) % 2 != 0), F.lit(False)),
        norm_eps=c("norm_eps") <= 0, rope_theta=c("rope_theta") <= 0, dropout=(c("dropout") < 0) | (c("dropout") >= 1), window_in_context=c("local_window") > c("max_seq_len"),
        edu=edu & ((c("n_kv_heads") != c("n_heads")) | c("qk_norm") | (c("attention_pattern") != "full") | (c("global_position_encoding") != "rope")),
        modern=(c("preset") == "modern") & (c("n_kv_heads") >= c("n_heads")), no_positions=(c("global_position_encoding") == "none") & ~hybrid,
        preset=~c("preset").isin("edu", "modern"), pattern=~c("attention_pattern").isin("full", "hybrid"), positions=~c("global_position_encoding").isin("rope", "none"),
        implementation=~c("attention_impl").isin("auto", "flex", "manual", "sdpa"), hybrid_dropout=(c("dropout") > 0) & hybrid & c("attention_impl").isin("auto", "flex"),
    )


def training_violations() -> Column:
    """Rules of a training run's settings."""
    c = F.col
    in_range = lambda n: (c(n) >= 0) & (c(n) < 1)
    return violations(
        updates=c("updates") <= 0, warmup=(c("warmup") < 0) | (c("warmup") >= c("updates")), rate=(c("rate") <= 0) | (c("least_rate") < 0), least_rate=c("least_rate") > c("rate"),
        betas=~(in_range("beta1") & in_range("beta2")), decay_or_clip=(c("decay") < 0) | (c("clip") <= 0), accumulation=c("accumulation") <= 0, interval=c("interval") < 0,
    )


def protocol_violation(least_tokens: int = 3_000_000_000) -> Column:
    """The first broken rule: a known status, positive sizes, seeds, names; a frozen protocol has evidence, and approval where its budget is small."""
    c = F.col
    frozen = c("status") == "frozen"
    sizes = F.least("target_tokens", "batch_tokens", F.col("sequence_length").cast("long"), F.col("evaluation_interval").cast("long"))
    named = F.array(*(F.coalesce(c(n), F.lit("")) for n in ("tokenizer_sha256", "data_mixture_id", "optimizer")))
    return (
        F.when(~c("status").isin("draft", "frozen"), "status")
        .when(sizes <= 0, "not_positive")
        .when((c("learning_rate") <= 0) | (F.coalesce(c("seeds"), F.lit(0)) == 0), "rate_or_seeds")
        .when(F.array_contains(named, ""), "identity")
        .when(frozen & (F.coalesce(c("evidence"), F.lit(0)) == 0), "no_evidence")
        .when(frozen & (c("target_tokens") < least_tokens) & ~F.coalesce(c("approved"), F.lit(False)), "small_budget")
    )


@dataclass(frozen=True)
class Limits:
    """Where scaling up stops."""

    memory: float = 0.95
    hours: float = 24.0
    failures: int = 1
    nonfinite: int = 0
    updates: int = 20


def scale_decision(limits: Limits = Limits()) -> tuple[Column, Column]:
    """(decision, reasons) of a measurement's row; one that isn't of a completed run on a real device is invalid."""
    c = F.col
    reasons = violations(
        memory=c("memory") > limits.memory, hours=c("hours") > limits.hours, out_of_memory=c("failures") > limits.failures, nonfinite=c("nonfinite") > limits.nonfinite,
        updates=c("updates") < limits.updates, resume=~c("resumed"), no_improvement=c("loss_end") >= c("loss_start"), throughput=c("tokens_per_second") <= 0, learning_value=c("learning_value") == "low",
    )
    valid = (c("device") == "cuda") & (c("status") == "completed")
    decision = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.size(reasons) == 0, "go").otherwise("no_go")
    return decision, F.when(decision != "invalid", reasons)


def merge_measurements(trainer: DataFrame, profile: DataFrame) -> DataFrame:
    """Trainer's and profiler's rows of a run in one, with the greater of their peaks; a CPU run fails."""
    joined = trainer.join(profile.select("run_id", F.col("memory").alias("__m")), "run_id").withColumn("memory", F.greatest("memory", "__m")).drop("__m")
    cpu = F.when(F.col("device") == "cpu", F.raise_error(F.lit("a CPU run measures nothing")).cast("boolean")).otherwise(True)
    return joined.where(cpu)


def pair_differences(a: str, b: str, names: list[str]) -> Column:
    """array<string>: the fields of two structs that should be equal and aren't."""
    return F.array_compact(F.array(*(F.when(~F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")), F.lit(n)) for n in names)))


def external_violation() -> Column:
    """A passed record of another runtime needs parity, metrics and hashes, none of them unmeasured."""
    c = F.col
    passed = c("status") == "passed"
    return F.when(~c("status").isin("passed", "failed", "unmeasured"), "status").when(passed & ~F.coalesce(c("parity"), F.lit(False)), "parity").when(passed & (F.coalesce(F.size("metrics"), F.lit(0)) <= 0), "metrics").when(passed & (F.trim(F.coalesce("artifact_hash", F.lit(""))) == ""), "hash").when(passed & F.exists(F.map_values("metrics"), lambda v: v == "unmeasured"), "unmeasured")


def layer_is_local(layer: Column, pattern: Column) -> Column:
    """In a hybrid pattern every fourth layer sees the whole context, the others a window."""
    return (pattern == "hybrid") & (layer % 4 != 3)


def cache_bytes(configs: DataFrame, batch: int, context: int, width: int = 2) -> DataFrame:
    """(name, full_bytes, bounded_bytes): keys and values of all layers; a local layer needs its window only."""
    layer = configs.select("*", F.explode(F.sequence(F.lit(0), F.col("n_layers") - 1)).alias("layer"))
    one = F.lit(2 * batch * width).cast("long") * F.col("n_kv_heads") * F.floor(F.col("d_model") / F.col("n_heads"))
    bounded = F.when(layer_is_local(F.col("layer"), F.col("attention_pattern")), F.least(F.lit(context), F.col("local_window"))).otherwise(context)
    return layer.groupBy("name").agg(F.sum(one * context).cast("long").alias("full_bytes"), F.sum(one * bounded).cast("long").alias("bounded_bytes"))


def parameters() -> Column:
    """Weights of a decoder with tied embeddings, from its dimensions."""
    c = lambda n: F.col(n).cast("long")
    head = F.floor(c("d_model") / c("n_heads"))
    norm = F.when(F.col("qk_norm"), head * 2).otherwise(0)
    attention = c("d_model") * (c("n_heads") + c("n_kv_heads")) * head * 2
    return (c("vocab_size") * c("d_model") + c("n_layers") * (attention + c("d_model") * c("d_ff") * 3 + c("d_model") * 2 + norm) + c("d_model")).cast("long")


def training_bytes(count: Column) -> Column:
    """At least: weights and gradients of 2 bytes, two moments of 4."""
    return count * 12
