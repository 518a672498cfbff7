"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document is the set of its word trigrams (textvec.words; a text of fewer words is one shingle). The sketch has t
coordinates and is filled in rounds: in round i < t each element is thrown into a hashed bin, in round t + j
every element is thrown into bin j, and a bin keeps the least (round, hash); a document stops after the round in which its last
bin fills, so every coordinate is filled after 2 t rounds at the latest, and long documents need one or two. Bands of
`rows` coordinates are the candidates' keys: each key links its documents to the least of them, linear in the number of documents however
many share the key. Two hashes of 64 bits stand for a text, so equal texts are one node from the start, and a group of copies of
any size is one text in what follows. Connected components of the links (large-star, small-star) bring each candidate group into one
task, each text of it once, where the exact Jaccard similarities decide. Nothing is capped: inside a group the documents near
a popular pivot are joined first, then prefix filtering, which loses no pair, finds the remaining ones. Least members are aggregated, then joined,
never sorted in a window, so that adaptive execution can split a hot key. A candidate group's different texts have to fit into one task.

The result: documents of Jaccard similarity `threshold` or more are joined, and of each connected group the least id
stays. With 40 bands of 4 rows a pair at 0.5 is found with probability 0.92, at 0.6 0.996, before links through others.

Defined results: a null text and a text without words are near nothing and stay. A null id counts as the greatest. Rows that
repeat id and text are near copies of one another, and one stays. Texts of any length are taken whole; a pair just at the threshold is joined; ids are whole numbers. Other columns take no part and are returned as they are. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import textvec
from sievework.llm.shared import written

BANDS, ROWS, SHINGLE, THRESHOLD = 40, 4, 3, 0.5
_LOW = np.uint64((1 << 48) - 1)


def shingles(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, repeats included, and the index of each text's first."""
    word, first = textvec.words(data, offs)
    return textvec.shingle_hashes(word, first, n)


def sketch(element: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """The (documents, t) sketch; documents without elements keep the greatest value everywhere."""
    docs = len(first) - 1
    out = np.full(docs * t, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(first))
    empty = np.iinfo(np.uint64).max
    for i in range(2 * t):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            h = textvec.mix(element + np.uint64(i + 1) * np.uint64(0xA24BAED4963EE407))
        bin_ = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else np.full(len(h), i - t)
        at = doc * t + bin_
        free = np.flatnonzero(out[at] == empty)  # what an earlier round filled stays
        np.minimum.at(out, at[free], (np.uint64(i) << np.uint64(48)) | (h[free] & _LOW))
        open_ = (out.reshape(docs, t) == empty).any(axis=1)
        still = open_[doc]
        if not still.all():
            element, doc = element[still], doc[still]
    return out.reshape(docs, t)


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, different bands having different keys."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketches), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = textvec.mix(key * np.uint64(0x9E3779B97F4A7C15) + sketches[:, r::rows][:, :bands])
    return key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = textvec.utf8(batch.column("__text"))
        node = batch.column("__h").to_numpy(zero_copy_only=False)
        for i, j in textvec.pieces(offs):
            element, first = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            has = np.flatnonzero(np.diff(first))
            has = has[np.unique(node[i:j][has], return_index=True)[1]]  # copies in this piece have the same keys
            if len(has):
                keys = band_keys(sketch(element, first, BANDS * ROWS)[has])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[i:j][has], BANDS)), pa.array(keys.ravel().view(np.int64))], names=["node", "key"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (u, v) edges, the root being the least node of its component."""
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "near-down")
        starred = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = written(starred.select("v", "m").union(starred.select("u", "m")).where("v <> m").distinct().toDF("u", "v"), "near-edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now


class _Joined:
    """Disjoint sets whose root is the least member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def components(sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[int]:
    """For each set the least index of its connected component, sets being linked at Jaccard similarity `threshold` or more."""
    joined = _Joined(len(sets))
    same: dict[bytes, int] = {}
    for i, s in enumerate(sets):
        joined.join(same.setdefault(s.tobytes(), i), i)
    pick = list(same.values())
    if len(pick) > 1:
        _link([sets[i] for i in pick], pick, joined, threshold)
    return [joined.root(i) for i in range(len(sets))]


def _link(sets: list[np.ndarray], name: list[int], joined: _Joined, threshold: float) -> None:
    size = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size)])
    vocab, flat, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    mark = np.zeros(len(vocab), bool)

    def near(p: int, others: np.ndarray) -> np.ndarray:
        mine = flat[begin[p] : begin[p + 1]]
        mark[mine] = True
        n = size[others]
        cut = np.cumsum(n) - n
        hits = mark[flat[np.repeat(begin[others] - cut, n) + np.arange(int(n.sum()))]]
        both = np.add.reduceat(hits.astype(np.int64), cut)
        mark[mine] = False
        return others[both >= threshold * (size[p] + n - both)]

    popular = np.add.reduceat(df[flat].astype(np.float64), begin[:-1]) / size
    pending = np.ones(len(sets), bool)
    while pending.sum() > 32:
        p = int(np.argmax(np.where(pending, popular, -1)))
        found = near(p, np.arange(len(sets)))
        for q in found.tolist():
            joined.join(name[p], name[q])
        pending[found] = False
        if len(found) < 16:
            break
    # Sets this similar share one of their rarest size - ceil(threshold * size) + 1 elements.
    order = np.lexsort((flat, df[flat], np.repeat(np.arange(len(sets)), size)))
    reach = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    inside = np.arange(len(flat)) - np.repeat(begin[:-1], size) < np.repeat(reach, size)
    prefix = flat[order]
    use = inside & (df[prefix] > 1)
    element, holder = prefix[use], np.repeat(np.arange(len(sets)), size)[use]
    by = np.lexsort((holder, element))
    element, posted = element[by], holder[by]
    start, stop = np.searchsorted(element, np.arange(len(vocab))), np.searchsorted(element, np.arange(len(vocab)), "right")
    own = np.split(prefix[use], np.searchsorted(holder, np.arange(1, len(sets))))
    roots = np.array([joined.root(n) for n in name])
    for p in range(len(sets)):
        if not len(own[p]):
            continue
        others = np.unique(np.concatenate([posted[start[e] : stop[e]] for e in own[p]]))
        others = others[(others < p) & (roots[others] != roots[p])]
        others = others[np.minimum(size[others], size[p]) >= threshold * np.maximum(size[others], size[p])]
        if len(others):
            found = near(p, others)
            for q in found.tolist():
                joined.join(name[p], name[q])
            if len(found):
                roots = np.array([joined.root(n) for n in name])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each root in turn, each text once; batches may cut through them."""
    held: list[pa.RecordBatch] = []
    root, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        roots, h, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__root", "__h", "__g"))
        again = np.zeros(len(roots), bool)
        again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (roots[1:] == roots[:-1])
        again[0] = last == (roots[0], h[0], g[0])
        last = (roots[-1], h[-1], g[-1])
        batch, roots = batch.filter(pa.array(~again)), roots[~again]
        cut = [0, *(np.flatnonzero(roots[1:] != roots[:-1]) + 1).tolist(), len(roots)]
        for i, j in zip(cut[:-1], cut[1:]):
            if i == j:
                continue
            if held and roots[i] != root:
                yield pa.Table.from_batches(held)
                held = []
            root = roots[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _labels(table: pa.Table, threshold: float) -> list[int]:
    data, offs = textvec.utf8(table.column("__text"))
    sets: list[np.ndarray] = []
    for i, j in textvec.pieces(offs):
        element, first = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        sets += [np.unique(element[a:b]) for a, b in zip(first[:-1], first[1:])]
    return components(sets, threshold)


def _prepared(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Id, text and its two hashes; __worded: whether it has a word."""
    row = [F.struct("*").alias("__row")] if whole else []
    plain = docs.select(*row, F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    worded = F.coalesce(F.col("__text").rlike("[0-9A-Za-z_]|[^\\x00-\\x7f]"), F.lit(False))
    return plain.withColumns({"__h": F.xxhash64("__text"), "__g": F.xxhash64(F.lit(17), "__text"), "__worded": worded})


def _members(plain: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(__id, __h, __g, __worded, __r) of every row, and of each text with words (__h, __g, __keeper, __first, __group, __rep).

    __keeper is the least id that has the text, __first the __r of its first row, __group the id of its class and __rep whether the text is the one that stays.
    """
    light = written(plain.select("__id", "__h", "__g", "__worded").withColumn("__r", F.monotonically_increasing_id()), "near-rows")
    first = F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__r").alias("r")))
    texts = light.where("__worded").groupBy("__h", "__g").agg(first.alias("f"))
    texts = written(texts.select("__h", "__g", F.col("f.id").alias("__keeper"), F.col("f.r").alias("__first")), "near-texts")
    keys = written(plain.where("__worded").select("__h", "__text").mapInArrow(_keys, "node long, key long"), "near-keys")
    by_key = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    edges = written(keys.join(by_key, "key").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "near-links")
    roots = written(connected(edges).toDF("__h", "__root"), "near-roots")
    # Joined by shuffle at every size, for the roots grow with the documents; by id too, so that copies of a text spread.
    chosen = written(texts.join(roots.hint("merge"), "__h"), "near-chosen")
    mine = plain.where("__worded").select("__id", "__h", "__g", "__text").alias("d")
    same = F.col("d.__id").eqNullSafe(F.col("c.__keeper")) & (F.col("d.__h") == F.col("c.__h")) & (F.col("d.__g") == F.col("c.__g"))
    met = mine.join(chosen.alias("c").hint("merge"), same).select("__root", "__id", "d.__h", "d.__g", "__text")
    met = met.repartition("__root").sortWithinPartitions("__root", F.col("__id").asc_nulls_last(), "__h", "__g")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            label = np.array(_labels(table, threshold))
            ids = table.column("__id").combine_chunks()
            columns = [table.column("__h").combine_chunks(), table.column("__g").combine_chunks(), ids.take(pa.array(label)), pa.array(label == np.arange(len(label)))]
            yield pa.RecordBatch.from_arrays(columns, names=["__h", "__g", "__group", "__rep"])

    classes = written(met.mapInArrow(verify, "__h long, __g long, __group long, __rep boolean"), "near-classes")
    joined = texts.join(classes.hint("merge"), ["__h", "__g"], "left")
    # A text without candidates is a class of its own.
    members = joined.withColumns({"__group": F.when(F.col("__rep").isNull(), F.col("__keeper")).otherwise(F.col("__group")), "__rep": F.coalesce("__rep", F.lit(True))})
    return light, written(members, "near-members")


def find_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, keep) for each row of docs: the group's id is the least of it."""
    light, members = _members(_prepared(docs, id_col, text_col, False), threshold)
    rows = light.where("__worded").join(members.hint("merge"), ["__h", "__g"])
    stays = F.col("__rep") & (F.col("__r") == F.col("__first"))
    alone = light.where("not __worded").select(F.col("__id").alias("doc_id"), F.col("__id").alias("group_id"), F.lit(True).alias("keep"))
    return rows.select(F.col("__id").alias("doc_id"), F.col("__group").alias("group_id"), stays.alias("keep")).union(alone)


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group, all columns kept."""
    plain = _prepared(docs, id_col, text_col, True)
    _, members = _members(plain.drop("__row"), threshold)
    keepers = members.where("__rep").select(F.col("__h").alias("__kh"), F.col("__g").alias("__kg"), "__keeper")
    same = F.col("__id").eqNullSafe(F.col("__keeper")) & (F.col("__h") == F.col("__kh")) & (F.col("__g") == F.col("__kg"))
    met = plain.where("__worded").select("__row", "__id", "__h", "__g").join(keepers.hint("merge"), same)
    # Rows that repeat id and text are all met; one stays.
    once = F.row_number().over(Window.partitionBy("__id", "__h", "__g").orderBy("__id"))
    kept = met.withColumn("__n", once).where("__n = 1").select("__row.*")
    return kept.union(plain.where("not __worded").select("__row.*"))
