"""Hidden Markov language model: distributed Baum-Welch over all documents, then exact sequence likelihoods.

The symbols are the words of textvec.words (a 64-bit hash stands for a word); those that the whole corpus
holds fewer than `min_count` times share one symbol. With `split_rare` a score gives each of them an equal share of the symbol's
probability, so that the words' probabilities sum to 1; training is the same either way, for a factor common to all states cancels.

Each task writes its documents as block files into the shared folder: words as indices into the block's own vocabulary, in
compressed chunks, so that a task holds one chunk of tokens at a time, whatever the size of the block, and no tokens pass through Spark's rows. An
iteration is one job:

    new parameters of each block's words (shuffle by block) -> expected counts of the whole block (map)
        -> sum by range of words (shuffle) -> a table of each block's parameters by range, in the shared folder

so that nothing the size of the vocabulary ever reaches the driver or is broadcast. The words' keys move once: what each range
has learnt of the blocks' words stays as a file in the shared folder, and later only numbers move. Rows are made for
pairs of a block and a range that have words in common only. Only the states' totals, K * (K + 3) numbers, come to the driver.

Defined results: a null or empty text, or one without words, has no tokens, likelihood 1 (log 0.0) and null
perplexity. A text of any length is one sequence. Repeated rows are scored each. Columns other than the id (a whole number) and the text are ignored. An empty table gives an
empty result. A null id is returned as null.
"""

from __future__ import annotations

import heapq
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textvec
from sievework.llm.shared import fresh, open_fs, release, remove, written

BLOCK = "block long, path string, n_vocab long, n_tokens long"
#: What a block gets: first its file, as part -1, then by ranges of words which of its words are known, and their parameters.
SLICE = "block long, part int, path string, mask binary, body binary"
#: What a range gets of each block: the words' keys (the first time only) and their counts.
COUNTS = "part int, block long, keys binary, body binary"
#: Totals of all blocks travel as parts below 0, so many that none gathers more than its share.
TOTAL_PARTS = 16
#: Tokens that the recursions take at once.
BATCH = 500_000
#: Tokens that a chunk of a block has, about. They are laid out by length, so that long documents run side by side.
CHUNK = 3_000_000
#: Bytes of input from which a block is made, about; smaller inputs give two blocks for each core.
BLOCK_BYTES = 64 << 20
#: Bytes that an iteration moves, from which its shuffle files are removed at once.
TIDY_BYTES = 32 << 20


class _BlockWriter:
    """A block's file: chunks as they fill, then the vocabulary (sorted) and counts, then where each part is."""

    def __init__(self, uri: str) -> None:
        self.where, folder = open_fs(uri)
        self.where.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        self.aside, self.path, self.uri = f"{folder}/.{name}", f"{folder}/{name}", f"{uri}/{name}"
        self.out, self.at = self.where.open_output_stream(self.aside), 0
        self.seen, self.seen_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted keys, and which in the order of appearance
        self.counts = np.zeros(0, np.int64)
        self.tokens = self.held = 0
        self.parts: dict[str, list] = {"chunks": []}
        self.ids: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []
        self.body: list[np.ndarray] = []

    def add(self, ids: pa.Array, lens: np.ndarray, word: np.ndarray) -> None:
        own, where, n = np.unique(word, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.seen, own)
        new = np.ones(len(own), bool)
        inside = at < len(self.seen)
        new[inside] = self.seen[at[inside]] != own[inside]
        number = np.empty(len(own), np.int64)
        number[~new] = self.seen_at[at[~new]]
        number[new] = np.arange(len(self.seen), len(self.seen) + int(new.sum()))
        self.seen, self.seen_at = np.insert(self.seen, at[new], own[new]), np.insert(self.seen_at, at[new], number[new])
        self.counts = np.concatenate([self.counts, np.zeros(int(new.sum()), np.int64)])
        self.counts[number] += n
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.null.append(ids.is_null().to_numpy(zero_copy_only=False))
        self.lens.append(lens.astype(np.int32))
        self.body.append(number.astype(np.uint32)[where])
        self.tokens += len(word)
        self.held += len(word)
        if self.held >= CHUNK:
            self._flush()

    def _put(self, *arrays: np.ndarray) -> list[int]:
        raw = zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))
        self.out.write(raw)
        self.at += len(raw)
        return [self.at - len(raw), len(raw)]

    def _flush(self) -> None:
        if self.ids:
            lens = np.concatenate(self.lens)
            self.parts["chunks"].append([*self._put(np.concatenate(self.ids), lens, np.concatenate(self.body), np.concatenate(self.null)), len(lens), self.held])
            self.ids, self.null, self.lens, self.body, self.held = [], [], [], [], 0

    def close(self) -> tuple[str, int, int]:
        self._flush()
        rank = np.empty(len(self.seen), np.uint32)
        rank[self.seen_at] = np.arange(len(self.seen))
        self.parts["vocab"] = [*self._put(self.seen, self.counts[self.seen_at].astype(np.int32), rank), len(self.seen)]
        foot = json.dumps(self.parts).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little"))
        self.out.close()
        self.where.move(self.aside, self.path)
        return self.uri, len(self.seen), self.tokens


class Block:
    """A block's file, read by ranges."""

    def __init__(self, uri: str) -> None:
        where, path = open_fs(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.parts = json.loads(self.file.read_at(length, size - 8 - length))
        at, size, n = self.parts["vocab"]
        raw = self._get(at, size)
        self.vocab, self.counts, self.rank = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int32, n, 8 * n), np.frombuffer(raw, np.uint32, n, 12 * n)
        self.tokens = sum(c[3] for c in self.parts["chunks"])

    def _get(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(size, at))

    def chunks(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Ids, lengths and tokens, as indices into the vocabulary, of the documents in turn."""
        for at, size, docs, tokens in self.parts["chunks"]:
            raw = self._get(at, size)
            ids, lens, body = np.frombuffer(raw, np.int64, docs), np.frombuffer(raw, np.int32, docs, 8 * docs), np.frombuffer(raw, np.uint32, tokens, 12 * docs)
            null = np.frombuffer(raw, bool, docs, 12 * docs + 4 * tokens)
            yield pa.array(ids, mask=null), lens.astype(np.int64), self.rank[body]


def _encode(batches: Iterator[pa.RecordBatch], uri: str, tokens_per_block: int) -> Iterator[pa.RecordBatch]:
    """Block files of consecutive documents."""
    from pyspark import TaskContext

    part, serial, writer = TaskContext.get().partitionId(), 0, None

    def closed(writer: _BlockWriter) -> pa.RecordBatch:
        nonlocal serial
        path, vocab, tokens = writer.close()
        serial += 1
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + serial - 1]), pa.array([path]), pa.array([vocab]), pa.array([tokens])], names=["block", "path", "n_vocab", "n_tokens"])

    for batch in batches:
        data, offs = textvec.utf8(batch.column(1))
        for i, j in textvec.pieces(offs):
            word, first = textvec.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            if writer is not None and writer.tokens + len(word) > tokens_per_block:
                yield closed(writer)
                writer = None
            if writer is None:
                writer = _BlockWriter(uri)
            writer.add(batch.column(0).slice(i, j - i), np.diff(first), word)
    if writer is not None:
        yield closed(writer)


def lanes(lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lay sequences end to end on `width` lanes of nearly equal length: each sequence's lane and its first step."""
    lane, step = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
    heap = [(0, k) for k in range(width)]
    for d in np.argsort(-lens, kind="stable"):
        used, k = heapq.heappop(heap)
        lane[d], step[d] = k, used
        heapq.heappush(heap, (used + int(lens[d]), k))
    return lane, step


def _layout(tokens: np.ndarray, lens: np.ndarray, pad: int) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """Tokens as a (steps, lanes) grid, the lanes where a sequence begins at each step, and each sequence's place."""
    width = int(min(512, max(8, tokens.size // max(1, int(lens.max())))))
    lane, step = lanes(lens, width)
    steps = int((step + lens).max())
    grid = np.full((steps, width), pad, np.int32)
    where = np.repeat(step - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(tokens.size)
    grid[where, np.repeat(lane, lens)] = tokens
    order = np.argsort(step, kind="stable")
    cut = np.searchsorted(step[order], np.arange(steps + 1))
    begins = [lane[order[cut[t] : cut[t + 1]]] for t in range(steps)]
    return grid, begins, lane, step


def _gathered(emit: np.ndarray, grid: np.ndarray, kind: type) -> np.ndarray:
    """Emissions at each place of the grid as (steps, states, lanes), ones where it is empty: operations then run along the lanes."""
    table = np.concatenate([emit, np.ones((1, emit.shape[1]))]).astype(kind)
    return np.ascontiguousarray(np.take(table, grid, axis=0).transpose(0, 2, 1))


def forward(tokens: np.ndarray, lens: np.ndarray, emit: np.ndarray, pi: np.ndarray, move: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Log-likelihood of each sequence (all of one token or more) by the scaled forward recursion."""
    grid, begins, lane, step = _layout(tokens, lens, len(emit))
    e, start, onward, one = _gathered(emit, grid, kind), pi.astype(kind)[:, None], np.ascontiguousarray(move.T, kind), np.ones(len(pi), kind)
    alpha, scale = np.full((len(pi), grid.shape[1]), 1 / len(pi), kind), np.empty(grid.shape, kind)
    for t in range(len(grid)):
        alpha = onward @ alpha
        if len(begins[t]):
            alpha[:, begins[t]] = start
        alpha *= e[t]
        np.matmul(one, alpha, out=scale[t])
        alpha /= scale[t]
    running = np.concatenate([np.zeros((1, grid.shape[1])), np.cumsum(np.log(scale, dtype=np.float64), axis=0)])
    return running[step + lens, lane] - running[step, lane]


def expected(tokens: np.ndarray, lens: np.ndarray, emit: np.ndarray, pi: np.ndarray, move: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts over sequences of one token or more: emissions, transitions, beginnings; and the log-likelihood."""
    k, pad = len(pi), len(emit)
    grid, begins, lane, step = _layout(tokens, lens, pad)
    steps, width = grid.shape
    e, first, one = _gathered(emit, grid, kind), pi.astype(kind)[:, None], np.ones(k, kind)
    back, onward = np.ascontiguousarray(move, kind), np.ascontiguousarray(move.T, kind)
    alpha, scale = np.empty((steps, k, width), kind), np.empty((steps, width), kind)
    now = np.full((k, width), 1 / k, kind)
    for t in range(steps):
        now = np.matmul(onward, now, out=alpha[t])
        if len(begins[t]):
            now[:, begins[t]] = first
        now *= e[t]
        np.matmul(one, now, out=scale[t])
        now /= scale[t]
    used = np.bincount(lane, lens, width).astype(np.int64)  # the lanes' lengths; beyond them all is empty
    live = (np.arange(steps)[:, None] < used).astype(kind)
    loglik = float((np.log(scale, dtype=np.float64) * live).sum())
    np.divide(live, scale, out=scale)
    stops: dict[int, np.ndarray] = {int(n): np.flatnonzero(used == n) for n in np.unique(used)}
    pairs, start = np.zeros((k, k)), np.zeros(k)
    beta = np.ones((k, width), kind)
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            ahead = e[t + 1]
            ahead *= beta
            ahead *= scale[t + 1]
            fresh_ = begins[t + 1]
            if len(fresh_):
                ahead[:, fresh_] = 0
            pairs += alpha[t] @ ahead.T
            beta = back @ ahead
            if len(fresh_):
                beta[:, fresh_] = 1
            if t + 1 in stops:
                beta[:, stops[t + 1]] = 1
        alpha[t] *= beta
        if len(begins[t]):
            start += alpha[t][:, begins[t]].sum(1)
    flat = grid.ravel()
    emits = np.stack([np.bincount(flat, alpha[:, j, :].ravel(), pad + 1)[:pad] for j in range(k)], axis=1)
    return emits, pairs * move, start, loglik


def _jitter(keys: np.ndarray, states: int, seed: int) -> np.ndarray:
    """Each word's unequal shares of the states at the start, from its hash."""
    with np.errstate(over="ignore"):
        h = textvec.mix(keys[:, None] + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    share = np.exp(4 * (h >> np.uint64(40)).astype(np.float64) / (1 << 24))
    return share / share.sum(1, keepdims=True)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of equal width of the hash; sorted keys give sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the ranges that sorted keys have members in."""
    part, begin = np.unique(_part_of(keys, parts), return_index=True)
    return zip(part.tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)])


def _counts_rows(block: int, cuts: Iterator[tuple[int, int, int]], keys: np.ndarray | None, values: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """The counts of a block's words, cut by ranges; and the totals."""
    rows = [(p, b"" if keys is None else keys[i:j].tobytes(), values[i:j].tobytes()) for p, i, j in cuts]
    rows.append((-1 - block % TOTAL_PARTS, b"", total.astype(np.float64).tobytes()))
    part, key, body = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([block] * len(part), pa.int64()), pa.array(key, pa.binary()), pa.array(body, pa.binary())], names=["part", "block", "keys", "body"])


def _grouped(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value in turn; batches may cut through them."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[name] != held[0][name]:
                yield held[0][name], held
                held = []
            held.append(row)
    if held:
        yield held[0][name], held


def _slice_rows(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    block, part, mask, body = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array([None] * len(rows), pa.string()), pa.array(mask, pa.binary()), pa.array(body, pa.binary())], names=["block", "part", "path", "mask", "body"])


def _save(uri: str, part: int, **arrays: np.ndarray) -> None:
    """A range's file: aside, then renamed, so that a task may run twice."""
    where, path = open_fs(uri)
    where.create_dir(path, recursive=True)
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    aside = f"{path}/.{part}-{uuid.uuid4().hex}"
    with where.open_output_stream(aside) as out:
        out.write(zstandard.ZstdCompressor(level=1).compress(raw.getvalue()))
    where.move(aside, f"{path}/{part}")


def _load(uri: str, part: int) -> dict[str, np.ndarray]:
    where, path = open_fs(uri)
    with where.open_input_file(f"{path}/{part}") as file:
        return dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(file.read()))))


def _first_sums(part: int, rows: list[dict], states: int, min_count: int, seed: int, uri: str) -> Iterator[pa.RecordBatch]:
    """From the counts of one range of words, its first parameters, cut into the slice of each block; what the range needs later is saved."""
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    vocab, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(r["body"], np.int32) for r in rows]), len(vocab))
    known = total >= min_count
    number = np.cumsum(known) - 1
    sums = (total[known, None] * _jitter(vocab[known], states, seed)).astype(np.float32)
    ends = np.cumsum([len(k) for k in keys])
    mine = [at[e - len(k) : e] for k, e in zip(keys, ends)]
    masks = [np.packbits(known[m]).tobytes() for m in mine]
    stay = [number[m[known[m]]].astype(np.int32) for m in mine]
    _save(uri, part, sizes=np.array([len(s) for s in stay]), at=np.concatenate(stay), masks=np.frombuffer(b"".join(masks), np.uint8), widths=np.array([len(m) for m in masks]))
    yield _slice_rows([(-1, part, b"", np.concatenate([[float(known.sum()), float(total[known].sum())], sums.sum(0, dtype=np.float64), [float((~known).sum())]]).tobytes())])
    for row, m, s in zip(rows, masks, stay):
        yield _slice_rows([(row["block"], part, m, sums[s].tobytes())])


def _later_sums(part: int, rows: list[dict], states: int, uri: str) -> Iterator[pa.RecordBatch]:
    """As _first_sums, from expected counts. A block without known words in the range sends none and gets none."""
    saved = _load(uri, part)
    has = np.flatnonzero(saved["sizes"])
    values = np.frombuffer(b"".join(r["body"] for r in rows), np.float32).reshape(-1, states)
    if len(rows) != len(has) or len(values) != len(saved["at"]):
        raise ValueError(f"range {part} has counts of {len(rows)} blocks; {len(has)} have its words")
    sums = np.stack([np.bincount(saved["at"], values[:, j]) for j in range(states)], axis=1).astype(np.float32)
    del values
    end, width = np.cumsum(saved["sizes"]), np.cumsum(saved["widths"])
    for row, b in zip(rows, has.tolist()):
        mine = saved["at"][end[b] - saved["sizes"][b] : end[b]]
        yield _slice_rows([(row["block"], part, saved["masks"][width[b] - saved["widths"][b] : width[b]].tobytes(), sums[mine].tobytes())])


def _emissions(vocab: np.ndarray, slices: list[dict], parts: int, states: int, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """p(word | state) of each word of a block's vocabulary, smoothed, and the indices of the known words; rare ones share a symbol."""
    down = model["emit_total"] + model["smooth"] * (model["vocab"] + 1)
    out = np.empty((len(vocab), states), np.float32)
    out[:] = (model["rare"] + model["smooth"]) / down / model["shares"]
    known = []
    at = {p: (i, j) for p, i, j in _cuts(vocab, parts)}
    for row in slices:
        i, j = at[row["part"]]
        known.append(i + np.flatnonzero(np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=j - i)))
        out[known[-1]] = (np.frombuffer(row["body"], np.float32).reshape(-1, states) + model["smooth"]) / down
    return out, np.concatenate(known) if known else np.zeros(0, np.int64)


def _sub_batches(tokens: np.ndarray, lens: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sequences with tokens, the longest first, in batches of about `size` tokens."""
    begin = np.concatenate([[0], np.cumsum(lens)])
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    ends = np.cumsum(lens[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        pick = order[i:j]
        n = lens[pick]
        at = np.repeat(begin[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        yield pick, tokens[at], n
        i = j


def _own_words(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that tokens of a vocabulary of `size` use, and the tokens as indices into them."""
    used = np.zeros(size, bool)
    used[tokens] = True
    own = np.flatnonzero(used)
    number = np.empty(size, np.int64)
    number[own] = np.arange(len(own))
    return own, number[tokens]


class Trained:
    """A model after training: its small part, each block's slices of the large part, and the log-likelihood before each iteration."""

    def __init__(self, model: dict, slices: DataFrame, parts: int, seen: list[float]) -> None:
        self.model, self.slices, self.parts, self.seen = model, slices, parts, seen


def _by_block(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """Each block's file and slices together, the file first."""
    whole = blocks.selectExpr("block", "-1 AS part", "path", "CAST(NULL AS binary) AS mask", "CAST(NULL AS binary) AS body").union(slices.where("block >= 0"))
    tasks = _tasks(blocks)
    place = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) * 7919, F.lit(tasks)).cast("int")
    return whole.repartitionById(tasks, place).sortWithinPartitions("block", "part")


def _tasks(blocks: DataFrame) -> int:
    """A task for every partition that blocks were made of, or block, whichever are more; many small blocks share one."""
    spark = blocks.sparkSession
    n = blocks.agg(F.countDistinct(F.shiftright("block", 32)).alias("n"), F.count("*").alias("m")).first()
    return max(1, n["n"], min(n["m"], 2 * spark.sparkContext.defaultParallelism))


def train(blocks: DataFrame, states: int, iterations: int, min_count: int, smooth: float, seed: int, words_per_part: int) -> Trained:
    """Baum-Welch over the blocks that encode() has made."""
    spark = blocks.sparkSession
    size = blocks.agg(F.sum("n_vocab").alias("n")).first()["n"] or 0
    parts = max(1, int(size // words_per_part))
    ranges, state = min(parts, 1 << 16), fresh(spark, "lm-ranges")
    tidy = (lambda: release(spark)) if size * 4 * states > TIDY_BYTES else lambda: None  # small shuffle files may stay until the driver collects its garbage

    def publish(rows: DataFrame, first: bool) -> tuple[str, DataFrame, list[np.ndarray]]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, held in _grouped(batches, "part"):
                if part < 0:
                    yield _slice_rows([(-1, part, b"", np.sum([np.frombuffer(r["body"], np.float64) for r in held], axis=0).tobytes())])
                elif first:
                    yield from _first_sums(part, held, states, min_count, seed, state)
                else:
                    yield from _later_sums(part, held, states, state)

        uri = fresh(spark, "lm-slices")
        spread = rows.repartitionById(ranges, F.pmod("part", F.lit(ranges)).cast("int")).sortWithinPartitions("part", "block")
        spread.mapInArrow(add, SLICE).write.parquet(uri)
        slices = spark.read.schema(SLICE).parquet(uri)
        return uri, slices, [np.frombuffer(r["body"], np.float64) for r in slices.where("block = -1").select("body").collect()]

    def first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(batches, "block"):
            block = Block(rows[0]["path"])
            total = np.zeros(states + 3)
            total[1] = -block.tokens  # with the known tokens, what the rare ones are
            yield _counts_rows(number, _cuts(block.vocab, parts), block.vocab, block.counts, total)

    uri, slices, total = publish(_by_block(blocks, spark.createDataFrame([], SLICE)).mapInArrow(first_counts, COUNTS), True)
    tidy()
    sums = np.sum(total, axis=0) if total else np.zeros(states + 3)
    rare_tokens = -sums[1]
    model = {
        "smooth": smooth, "vocab": float(sums[0]), "rare": np.full(states, rare_tokens / states), "emit_total": sums[2:-1] + rare_tokens / states,
        "rare_types": float(sums[-1]), "shares": 1.0,
        "pi": np.full(states, 1 / states), "move": (np.ones((states, states)) + states * np.eye(states)) / (2 * states),
    }
    seen: list[float] = []
    for _ in range(iterations):
        now = model

        def step(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            for number, rows in _grouped(batches, "block"):
                block = Block(rows[0]["path"])
                emit, known = _emissions(block.vocab, rows[1:], parts, states, now)
                emits, pairs, start, loglik = np.zeros(emit.shape), np.zeros((states, states)), np.zeros(states), 0.0
                for _, lens, tokens in block.chunks():
                    for _, tok, n in _sub_batches(tokens, lens, BATCH):
                        own, tok = _own_words(tok, len(emit))
                        a, b, c, d = expected(tok, n, emit[own], now["pi"], now["move"])
                        emits[own] += a
                        pairs += b
                        start += c
                        loglik += d
                every, mine = emits.sum(0), emits[known]
                total = np.concatenate([pairs.ravel(), start, every - mine.sum(0), every, [loglik]])
                yield _counts_rows(number, _cuts(block.vocab[known], parts), None, mine.astype(np.float32), total)

        old = uri
        uri, slices, total = publish(_by_block(blocks, slices).mapInArrow(step, COUNTS), False)
        remove(old)
        tidy()
        if not total:
            break
        sums, k = np.sum(total, axis=0), states
        pairs, start, rare, emit_total = sums[: k * k].reshape(k, k), sums[k * k : k * k + k], sums[k * k + k : k * k + 2 * k], sums[k * k + 2 * k : k * k + 3 * k]
        seen.append(float(sums[-1]))
        model = model | {
            "rare": rare, "emit_total": emit_total, "pi": (start + smooth) / (start.sum() + k * smooth),
            "move": (pairs + smooth) / (pairs.sum(1, keepdims=True) + k * smooth),
        }
    return Trained(model, slices, parts, seen)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_per_block: int | None = None) -> DataFrame:
    """Blocks of documents in the shared folder; gives their manifest.

    Splits are taken together for a block, by the size that Spark's statistics have for the table, since larger blocks have fewer words for each token.
    A table of few splits gives several blocks each, so that all cores have work. Neither changes what is learnt, but for rounding.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = int(str(picked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    uri = fresh(spark, "lm-blocks")
    cores = 2 * spark.sparkContext.defaultParallelism
    gathered = picked.coalesce(min(1 << 30, max(cores, -(-size // BLOCK_BYTES))))
    most = tokens_per_block or max(500_000, min(20_000_000, size // (2 * cores)))
    return written(gathered.mapInArrow(lambda it: _encode(it, uri, most), BLOCK), "lm-manifest")


def score_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = 8, iterations: int = 4, min_count: int = 5,
    smooth: float = 0.01, seed: int = 1, tokens_per_block: int | None = None, words_per_part: int = 400_000, split_rare: bool = False,
) -> DataFrame:
    """Train on all documents and score each: (doc_id, n_tokens, log_likelihood, perplexity), one row for each row of docs."""
    blocks = encode(docs, id_col, text_col, tokens_per_block)
    trained = train(blocks, states, iterations, min_count, smooth, seed, words_per_part)
    model, parts = trained.model, trained.parts
    if split_rare:
        model = model | {"shares": max(1.0, model["rare_types"])}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "block"):
            block = Block(rows[0]["path"])
            emit, _ = _emissions(block.vocab, rows[1:], parts, states, model)
            for ids, lens, tokens in block.chunks():
                out = np.zeros(len(lens))
                for pick, tok, n in _sub_batches(tokens, lens, BATCH):
                    own, tok = _own_words(tok, len(emit))
                    out[pick] = forward(tok, n, emit[own], model["pi"], model["move"])
                ppl = np.exp(-out / np.maximum(lens, 1))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lens), pa.array(out), pa.array(ppl, mask=lens == 0)], names=["doc_id", "n_tokens", "log_likelihood", "perplexity"])

    return _by_block(blocks, trained.slices).mapInArrow(score, "doc_id long, n_tokens long, log_likelihood double, perplexity double")
