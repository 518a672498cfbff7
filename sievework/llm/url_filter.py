"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

A URL is labelled bad where the document that its path names (the number in
/<language>/<number>) is labelled of quality 0, and good where that document is of quality 1; no list of words takes part. The features are lexical and computed
by Spark's own expressions: lengths, depth, ratios of digits and other signs, hyphens and labels of the host, entropy of the
characters, counts of parameters, and of the suffix (the host's last two labels) how many URLs and hosts of the whole
table have it and its share of bad ones among the labelled. That share comes from the half of the hosts that the URL's host isn't
in, so no URL's own label is in its features. The trees (histograms, logistic loss) are grown on
the driver from a sample of labelled rows bounded by `per_class` and go to the tasks, a few kilobytes; all rows are scored in Arrow batches.

Defined results: a null or empty URL has no score (null) and is not kept. Where the labels lack a class there is no model: scores are
null and all URLs are kept. Rows that repeat are scored each. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.labelled import sigmoid
from sievework.llm.shared import written

#: Probability of being bad from which a URL is dropped.
THRESHOLD = 0.5
FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "digit_ratio", "other_ratio", "hyphens", "host_hyphens", "labels", "entropy", "host_entropy", "parameters", "has_fragment", "secure", "suffix_urls", "suffix_hosts", "suffix_bad")
BINS = 32


def _entropy(text: Column) -> Column:
    """Entropy in nats of a text's characters."""
    n = F.length(text)

    def add(total: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - p * F.ln(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), add)).otherwise(0.0)


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, suffix, path, query, named): named is the document that the path names."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rest = F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = rows.withColumn("host", F.lower(F.regexp_extract(rest, "^(?:[^/?#@]*@)?([^/?#:]*)", 1))).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))
    rows = rows.withColumn("query", F.regexp_extract("url", "^[^?#]*\\?([^#]*)", 1)).withColumn("suffix", F.substring_index("host", ".", -2))
    return rows.withColumn("named", F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z]{2}/([0-9]{1,18})(?![0-9])', 1), '') AS bigint)"))


def _lexical(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.length("url"), F.lit(1))
    count = lambda column, what: F.length(column) - F.length(F.regexp_replace(column, what, ""))
    return rows.withColumns({
        "length": F.length("url"), "host_length": F.length("host"), "path_length": F.length("path"), "query_length": F.length("query"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")), "digit_ratio": count("url", "[0-9]") / n, "other_ratio": count("url", "[^0-9A-Za-z]") / n,
        "hyphens": count("url", "-"), "host_hyphens": count("host", "-"), "labels": F.size(F.split("host", "[.]")), "entropy": _entropy(F.col("url")), "host_entropy": _entropy(F.col("host")),
        "parameters": F.size(F.filter(F.split("query", "&"), lambda p: p != "")), "has_fragment": F.instr("url", "#") > 0, "secure": F.startswith(F.lower("url"), F.lit("https:")),
    })


def label_urls(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`bad`, 1, 0 or null where nothing is known, for each URL. The labels are joined by shuffle or broadcast as Spark finds them small.

    URLs that name no document, which may be most, are spread over keys below 0, where no label is.
    """
    one = labels.where(F.col("quality").isin(0, 1) & (F.col("doc_id") >= 0)).groupBy(F.col("doc_id").cast("long").alias("named")).agg(F.min("quality").alias("quality"))
    key = F.coalesce("named", -1 - F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 20)))
    known = F.when(F.length("host") > 0, 1 - F.col("quality")).cast("int")
    return rows.withColumn("key", key).join(one.withColumnRenamed("named", "key"), "key", "left").withColumn("bad", known).drop("quality", "key")


class Trees:
    """Boosted regression trees for the logistic loss, grown on histograms of the features' quantiles."""

    def __init__(self, base: float, trees: list[tuple[np.ndarray, ...]]) -> None:
        self.base, self.trees = base, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.1, least: float = 2.0, ridge: float = 1.0) -> Trees:
        rows, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # bin <= k means x <= edges[k]
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        base = float(np.log(mean / (1 - mean)))
        z, trees = np.full(rows, base), []
        for _ in range(rounds):
            p = sigmoid(z)
            slope, bend = p - y, np.maximum(p * (1 - p), 1e-9)
            size = (1 << (depth + 1)) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(rows, np.int64)
            for level in range(depth + 1):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    own = np.flatnonzero(node == k)
                    if not len(own):
                        continue
                    g, h = slope[own].sum(), bend[own].sum()
                    value[k] = -rate * g / (h + ridge)
                    if level == depth:
                        continue
                    best, at = 1e-6, None
                    for j in range(width):
                        if not len(edges[j]):
                            continue
                        b = binned[own, j]
                        gl = np.cumsum(np.bincount(b, slope[own], len(edges[j]) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, bend[own], len(edges[j]) + 1))[:-1]
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        gain[(hl < least) | (h - hl < least)] = -1
                        i = int(np.argmax(gain))
                        if gain[i] > best:
                            best, at = float(gain[i]), (j, i)
                    if at:
                        feature[k], cut[k] = at[0], edges[at[0]][at[1]]
                        node[own] = 2 * k + 1 + (x[own, at[0]] > cut[k])
            z += value[node]
            trees.append((feature, cut, value))
        return cls(base, trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class 1."""
        z = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                deeper = np.flatnonzero(f >= 0)
                if not len(deeper):
                    break
                node[deeper] = 2 * node[deeper] + 1 + (x[deeper, f[deeper]] > cut[node[deeper]])
            z += value[node]
        return sigmoid(z)


#: A suffix of this share of all URLs or more is hot; there are so many hot suffixes at most.
HOT = 1000


def _with_suffix(rows: DataFrame, by_suffix: DataFrame) -> DataFrame:
    """rows with the columns of their suffix. Hot suffixes, `HOT` at most, are broadcast; the rows that have one are spread over keys that no suffix is, so no key of the other join is hot."""
    stats = [c for c in by_suffix.columns if c != "suffix"]
    by_suffix = written(by_suffix, "url-suffixes")
    total = by_suffix.agg(F.sum("s_n").alias("n")).first()["n"] or 0
    hot = by_suffix.where(F.col("s_n") * HOT >= total).select("suffix", *(F.col(c).alias(f"hot_{c}") for c in stats))
    out = rows.join(F.broadcast(hot), "suffix", "left")
    key = F.when(F.col("hot_s_n").isNotNull(), F.concat(F.lit("/"), F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 20)).cast("string"))).otherwise(F.col("suffix"))
    out = out.withColumn("join_key", key).join(by_suffix.where(F.col("s_n") * HOT < total).withColumnRenamed("suffix", "join_key"), "join_key", "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in stats))


def _featured(pages: DataFrame, labels: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, url, bad, x) of all rows, in the shared folder."""
    rows = label_urls(parts(pages, id_col, url_col), labels)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(2)))
    shares = [F.coalesce(F.sum(F.when(F.col("fold") == k, c)), F.lit(0)).alias(f"{n}{k}") for k in (0, 1) for n, c in (("known", F.col("bad").isNotNull().cast("int")), ("bad", F.col("bad")))]
    by_suffix = rows.groupBy("suffix").agg(F.count("*").alias("s_n"), F.countDistinct("host").alias("s_hosts"), *shares)
    whole = rows.agg(F.coalesce(F.avg("bad"), F.lit(0.0)).alias("prior"))
    joined = _with_suffix(_lexical(rows), by_suffix).crossJoin(F.broadcast(whole))  # one row
    other = lambda name: F.coalesce(F.when(F.col("fold") == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0")), F.lit(0))
    stats = joined.withColumns({
        "suffix_urls": F.log1p("s_n"), "suffix_hosts": F.log1p("s_hosts"),
        "suffix_bad": (other("bad") + 20 * F.col("prior")) / (other("known") + 20),
    })
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES))
    return written(stats.select("page_id", "url", "bad", x.alias("x")), "url-features")


def train(rows: DataFrame, *, per_class: int = 10_000, seed: int = 5) -> Trees | None:
    """Trees from at most `per_class` labelled rows of each class, those of the least seeded hash; None where a class is absent."""
    drawn = [rows.where(F.col("bad") == c).orderBy(F.xxhash64(F.lit(seed), "url"), "page_id").limit(per_class) for c in (0, 1)]
    got = drawn[0].union(drawn[1]).select("bad", "x").toPandas()
    y = got["bad"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, y))
    return Trees.fit(x[order], y[order])


def filter_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, bad_score, keep) for each row of pages."""
    rows = _featured(pages, labels, id_col, url_col)
    trees = train(rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            has = np.array([bool(u) for u in urls], bool)
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(urls), len(FEATURES))
            p = trees.predict(flat) if trees else np.zeros(len(urls))
            keep = has & (p < threshold)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(p, mask=~has if trees else np.ones(len(urls), bool)), pa.array(keep)], names=["page_id", "url", "bad_score", "keep"])

    return rows.select("page_id", "url", "x").mapInArrow(score, "page_id long, url string, bad_score double, keep boolean")
