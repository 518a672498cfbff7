"""Predicates that give a reason for each rejected record, in a fixed order; counts never hold text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import schema
from sievework.functions import text as t


@dataclass(frozen=True)
class Bounds:
    """Inclusive limits of a text's length in code points."""

    low: int = 32
    high: int = 1_000_000

    def __post_init__(self) -> None:
        if self.low < 0 or self.high < self.low:
            raise ValueError("bounds are 0 at least and in order")

    def hold(self, text: Column) -> Column:
        return F.length(text).between(self.low, self.high)


@dataclass(frozen=True)
class CodeRules:
    """Limits of the code chain."""

    bounds: Bounds = Bounds()
    longest_line: int = 2000
    mean_line: float = 300.0
    personal_data: bool = True


def structural_reason(text: Column, bounds: Bounds = Bounds()) -> Column:
    """character_bounds, malformed or null."""
    return F.when(~bounds.hold(text), "character_bounds").when(t.blank_or_binary(text), "malformed")


def provenance_violation(d: str = "") -> Column:
    """The first broken rule of a document record, or null."""
    c = lambda name: F.col(f"{d}{name}")
    blank = lambda name: ~F.coalesce(c(name), F.lit("")).rlike(t.NOT_SPACE)
    missing = F.array_compact(F.array(*(F.when(blank(n), F.lit(n)) for n in schema.REQUIRED)))
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(~c("content_hash").eqNullSafe(t.content_hash(c("text"))), "content_hash")
        .when(c("parent_content_hash").isNotNull() & ~c("parent_content_hash").rlike(r"^[0-9a-f]{64}\z"), "parent_content_hash")
        .when((c("source_type") == "code") & ~c("license").isin(*schema.LICENCES), "license")
        .when(c("split").isNotNull() & ~c("split").isin(*schema.SPLITS), "split")
    )


def require_valid(documents: DataFrame) -> DataFrame:
    """Fail on the first record with a violation."""
    broken = provenance_violation()
    return documents.where(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("invalid document: "), broken)).cast("boolean")).otherwise(True))


def line_shape(text: Column) -> tuple[Column, Column]:
    """Longest and mean line length; a text without lines is one line."""
    rows = t.lines(text)
    sizes = F.transform(F.when(F.size(rows) > 0, rows).otherwise(F.array(text)), F.length)
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.array_max(sizes), total / F.size(sizes)


def code_reason(rules: CodeRules = CodeRules()) -> Column:
    """The first reason to reject a document as code, or null; cheap tests come first, patterns last."""
    text, path = F.col("text"), F.col("path")
    longest, mean = line_shape(text)
    lowered = F.lower(F.substring(text, 1, 2000))
    marked = F.lit(False)
    for marker in t.GENERATED:
        marked = marked | F.contains(lowered, F.lit(marker))
    foreign = F.arrays_overlap(F.split(F.lower(path), r"[/\\]+"), F.array(*(F.lit(v) for v in t.VENDOR)))
    reason = (
        F.when(~F.col("source_type").eqNullSafe("code"), "not_code")
        .when(F.coalesce(path, F.lit("")) == "", "missing_path")
        .when(~F.coalesce(F.col("license").isin(*schema.LICENCES), F.lit(False)), "license")
        .when(~rules.bounds.hold(text), "character_bounds")
        .when(t.blank_or_binary(text), "binary_or_empty")
        .when(foreign, "vendor_or_generated_path")
        .when(marked, "generated")
        .when(t.has_secret(text), "secret_or_credential")
    )
    if rules.personal_data:
        reason = reason.when(t.has_personal_data(text), "personal_data")
    return reason.when((longest > rules.longest_line) | (mean > rules.mean_line), "minified_or_malformed")


def filter_code(documents: DataFrame, rules: CodeRules = CodeRules()) -> tuple[DataFrame, DataFrame]:
    """Admitted documents, and the number of documents for each reason (null for the admitted)."""
    judged = documents.withColumn("reason", code_reason(rules))
    return judged.where("reason is null").drop("reason"), reason_counts(judged)


def reason_counts(judged: DataFrame) -> DataFrame:
    """Documents by reason; admitted ones are named so."""
    return judged.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))
