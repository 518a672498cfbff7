"""Byte-level BPE by a tokenization automaton: merges compiled into a deterministic automaton, words encoded by table lookups.

The automaton reads tokens. Its states are the last tokens read, and at first there are the bytes only, each allowed
after each. A merge u, v -> uv is a gadget on it: the new state uv gets the arcs of state v; then state u loses its arc v;
then every state with an arc u gets an arc uv. After the last merge a token sequence is a path exactly if it is what BPE makes of
its bytes. `compile_merges` adds the states one by one in the order of the merges: row s of the table is copied from
row v(s), less the arcs that state v had lost by then, and arcs to later tokens x follow those to u(x). Equal
rows are one state and equal columns one symbol class, so the table is stored once for both, as bits.

A word is encoded left to right. Every prefix of a word has one path, so position i keeps the last token of its
prefix's path: of the tokens that end there (a trie gives them), the one whose arc leaves the state at its start. The
labels on the way back from the end are the encoding. Decoding emits the labels' bytes.

Words are split as by the pattern of the vocabulary, on whole texts, by character classes: contractions, an optional space with
letters, numbers or other signs, and white space. The strings of special tokens are ordinary text.

Defined results: a null text has null tokens, null count and null round_trip; an empty text has no tokens. Rows that repeat are
encoded each. A text of any length is one list of tokens; a word of any length is walked whole. In decoding, an id that the vocabulary lacks
becomes the replacement character. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textvec
from sievework.llm.shared import fresh, open_fs, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words beyond this many bytes are walked one at a time.
LONG = 48
#: Encoded words that a task remembers at most, for speed.
REMEMBER = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_merges(path: str) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """Tokens in the order of creation (256 bytes, then one for each merge), their ids, and each merge's two parts."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    alphabet = byte_alphabet()
    raw = lambda shown: bytes(alphabet[c] for c in shown)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    shown = {b: c for c, b in alphabet.items()}
    tokens, ids = [bytes([b]) for b in range(256)], [vocab[shown[b]] for b in range(256)]
    at = {t: i for i, t in enumerate(tokens)}
    parts = []
    for left, right in pairs:
        u, v = raw(left), raw(right)
        parts.append((at[u], at[v]))
        at[u + v] = len(tokens)
        tokens.append(u + v)
        ids.append(vocab[left + right])
    return tokens, ids, parts


def compile_merges(parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(state class of each token, symbol class of each token, bits [state class, symbol class] of the allowed arcs, reached tokens).

    A merge whose parts can't follow one another when its turn comes makes nothing: its token is never reached.
    """
    n = 256 + len(parts)
    left = np.concatenate([np.full(256, -1), np.array([u for u, _ in parts], np.int64)]).astype(np.int64)
    lost: dict[int, list[tuple[int, int]]] = {}  # by u, the (v, token made) of each merge
    for k, (u, v) in enumerate(parts):
        lost.setdefault(u, []).append((v, 256 + k))
    deep = np.zeros(n, np.int64)
    for x in range(256, n):
        deep[x] = deep[left[x]] + 1
    levels = [np.flatnonzero(deep == d) for d in range(1, int(deep.max(initial=0)) + 1)]
    rows = np.zeros((n, (n + 7) // 8), np.uint8)
    arc = np.ones(n, bool)
    for s in range(n):
        made = lost.get(s, [])
        # The loss of arc (s, v) when token m was made is seen by the tokens from m on whose left part is v.
        late = {}
        for v, m in made:
            late[v] = m
        if s < 256:
            arc[:256] = True
        else:
            v = parts[s - 256][1]
            arc = np.unpackbits(rows[v], count=n).astype(bool)
            for x, m in lost.get(v, []):
                if m < s and x < s:
                    arc[x] = False
        for level in levels:
            x = level[np.searchsorted(level, s) :] if s >= 256 else level
            if not len(x):
                continue
            u = left[x]
            arc[x] = arc[u]
            for v, m in late.items():
                gone = x[(u == v) & (x >= m)] if len(late) < 64 else None
                if gone is None:
                    break
                arc[gone] = False
            if len(late) >= 64:
                when = np.full(n, n)
                when[list(late)] = list(late.values())
                arc[x[x >= when[u]]] = False
        rows[s] = np.packbits(arc)
    reached = np.ones(n, bool)
    for m, (u, v) in enumerate(parts, 256):
        reached[m] = reached[u] and reached[v] and bool((rows[u, v >> 3] >> (7 - (v & 7))) & 1)
    rows &= np.packbits(reached)
    for u, made in lost.items():  # what was lost after both were there
        for v, _ in made:
            rows[u, v >> 3] &= np.uint8(0xFF ^ (0x80 >> (v & 7)))
    return *_classes(rows, n), reached


def _classes(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge equal rows, then equal columns."""

    def same(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first: dict[bytes, int] = {}
        of = np.array([first.setdefault(r.tobytes(), len(first)) for r in table])
        keep = np.zeros(len(first), np.int64)
        keep[of[::-1]] = np.arange(len(table))[::-1]
        return of, keep

    state, keep = same(rows)
    rows = rows[keep]
    m = len(rows)
    columns = np.zeros((n, (m + 7) // 8), np.uint8)
    for i in range(0, n, 2048):
        part = np.unpackbits(rows[:, i // 8 : (i + 2048) // 8], axis=1)[:, : min(2048, n - i)]
        columns[i : i + 2048] = np.packbits(part.T, axis=1)
    symbol, keep = same(columns)
    columns = columns[keep]
    out = np.zeros((m, (len(columns) + 7) // 8), np.uint8)
    for i in range(0, m, 2048):
        part = np.unpackbits(columns[:, i // 8 : (i + 2048) // 8], axis=1)[:, : min(2048, m - i)]
        out[i : i + 2048] = np.packbits(part.T, axis=1)
    return state.astype(np.int32), symbol.astype(np.int32), out


def compile_trie(tokens: list[bytes], reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys node * 256 + byte, the node that each leads to, and each node's token or -1."""
    nodes: dict[tuple[int, int], int] = {}
    token = [-1]
    for t in np.flatnonzero(reached).tolist():
        raw, at = tokens[t], 0
        for b in raw:
            step = nodes.get((at, b))
            if step is None:
                step = nodes[(at, b)] = len(token)
                token.append(-1)
            at = step
        token[at] = t
    keys = np.array([(a << 8) | b for a, b in nodes], np.int64)
    to = np.array(list(nodes.values()), np.int32)
    order = np.argsort(keys)
    return keys[order], to[order], np.array(token, np.int32)


class Automaton:
    """The compiled tables, and what runs on them."""

    NAMES = ("state", "symbol", "arcs", "keys", "to", "token", "ids", "label_bytes", "label_at")

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        for name in self.NAMES:
            setattr(self, name, tables[name])
        self.by_id = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.by_id[self.ids] = np.arange(len(self.ids))
        self.root = np.full(256, -1, np.int32)
        first = self.keys < 256
        self.root[self.keys[first]] = self.to[first]
        # Byte ranges of each node's arcs: a step is a look into a hash of (node, byte).
        self._fill()
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_n = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)
        self.known_start = np.zeros(0, np.int64)
        self.known_size = np.zeros(0, np.int64)
        self.known_bytes = np.zeros(0, np.uint8)

    def _fill(self) -> None:
        size = 1 << (int(len(self.keys)).bit_length() + 2)
        self.slots, self.slot_to, self.slot_mask = np.full(size, -1, np.int64), np.full(size, -1, np.int32), size - 1
        key, to, probe = np.asarray(self.keys), np.asarray(self.to), 0
        while len(key):
            at = (self._spot(key) + probe) & self.slot_mask
            free = self.slots[at] < 0
            _, lead = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[lead]
            self.slots[at[put]], self.slot_to[at[put]] = key[put], to[put]
            stay = np.ones(len(key), bool)
            stay[put] = False
            key, to, probe = key[stay], to[stay], probe + 1
        self.probes = probe

    def _spot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.slot_mask

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's transition, -1 where there is none."""
        key = (node.astype(np.int64) << 8) | byte
        at = self._spot(key)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for p in range(self.probes):
            slot = (at[open_] + p) & self.slot_mask
            have = self.slots[slot]
            hit = have == key[open_]
            out[open_[hit]] = self.slot_to[slot[hit]]
            open_ = open_[~hit & (have >= 0)]
            if not len(open_):
                break
        return out

    def allowed(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether state s has an arc t."""
        c = self.symbol[t]
        return (self.arcs[self.state[s], c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0

    def run(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of equally long words, given as a (words, bytes) table: all tokens in order, and each word's count."""
        count, length = words.shape
        last = np.full((count, length + 1), -1, np.int32)
        back = np.zeros((count, length + 1), np.int32)
        for j in range(length):
            rows = np.arange(count)
            node = self.root[words[:, j]]
            end = j + 1
            while True:
                token = self.token[node]
                own = np.flatnonzero(token >= 0)
                if len(own):
                    r, t = rows[own], token[own]
                    if j:
                        ok = self.allowed(last[r, j], t)
                        r, t = r[ok], t[ok]
                    last[r, end], back[r, end] = t, j
                if end == length:
                    break
                node = self.step(node, words[rows, end])
                live = node >= 0
                rows, node = rows[live], node[live]
                if not len(rows):
                    break
                end += 1
        at, n = np.full(count, length), np.zeros(count, np.int64)
        found = []
        live = np.arange(count)
        while len(live):
            found.append((live, last[live, at[live]]))
            n[live] += 1
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        begin = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int32)
        for k, (r, t) in enumerate(found):
            out[begin[r] + n[r] - 1 - k] = t
        return out, n

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (as creation numbers) of the words data[start:end] in turn, and each word's count.

        Words seen before are looked up by hash, and their bytes compared; a word that only shares a hash is walked by itself.
        """
        hashes = textvec.span_hashes(data, starts, ends)
        own, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, own)
        new = np.ones(len(own), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != own[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBER and len(self.known):
                self.known, self.known_at, self.known_n, self.store, self.known_start, self.known_size, self.known_bytes = self.known[:0], self.known_at[:0], self.known_n[:0], self.store[:0], self.known_start[:0], self.known_size[:0], self.known_bytes[:0]
                new[:] = True
            fresh_ = np.flatnonzero(new)
            s, e = starts[first[fresh_]], ends[first[fresh_]]
            size = e - s
            begin, n, parts, base = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), [], len(self.store)
            order = np.argsort(size, kind="stable")
            cut = np.flatnonzero(np.diff(size[order])) + 1
            for group in np.split(order, cut):
                for i in range(0, len(group), 65_536):
                    some = group[i : i + 65_536]
                    table = data[s[some][:, None] + np.arange(size[some[0]])]
                    tokens, k = self.run(table) if size[some[0]] <= LONG or len(some) > 64 else self._each(table)
                    begin[some], n[some] = base + np.cumsum(k) - k, k
                    parts.append(tokens)
                    base += len(tokens)
            self.store = np.concatenate([self.store, *parts])
            known = np.concatenate([self.known, own[fresh_]])
            by = np.argsort(known, kind="stable")
            here = len(self.known_bytes) + np.cumsum(size) - size
            self.known_bytes = np.concatenate([self.known_bytes, data[np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]])
            self.known, self.known_at, self.known_n = known[by], np.concatenate([self.known_at, begin])[by], np.concatenate([self.known_n, n])[by]
            self.known_start, self.known_size = np.concatenate([self.known_start, here])[by], np.concatenate([self.known_size, size])[by]
            at = np.searchsorted(self.known, own)
        n, begin, store = self.known_n[at][where], self.known_at[at][where], self.store
        theirs = self.known_start[at][where]
        wrong = np.flatnonzero(~textvec.same_spans(data, starts, ends, self.known_bytes, theirs, theirs + self.known_size[at][where]))
        for w in wrong.tolist():
            tokens, k = self._each(data[starts[w] : ends[w]][None, :])
            begin[w], n[w] = len(store), k[0]
            store = np.concatenate([store, tokens])
        return store[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _each(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As run(), for long words: a walk by the bytes of one word at a time."""
        steps = self._steps()
        out, counts = [], []
        for word in table:
            raw, length = word.tolist(), len(word)
            last, back = [-1] * (length + 1), [0] * (length + 1)
            for j in range(length):
                here, node, end = last[j], 0, j
                row = self.arcs[self.state[here]] if j else None
                while end < length:
                    node = steps.get((node << 8) | raw[end], -1)
                    if node < 0:
                        break
                    end += 1
                    t = int(self.token[node])
                    if t >= 0:
                        c = int(self.symbol[t])
                        if row is None or (int(row[c >> 3]) >> (7 - (c & 7))) & 1:
                            last[end], back[end] = t, j
            path, at = [], length
            while at:
                path.append(last[at])
                at = back[at]
            out += path[::-1]
            counts.append(len(path))
        return np.array(out, np.int32), np.array(counts, np.int64)

    def _steps(self) -> dict[int, int]:
        if not hasattr(self, "_step_table"):
            self._step_table = dict(zip(self.keys.tolist(), self.to.tolist()))
        return self._step_table

    def labels(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of the tokens (as creation numbers), one after another."""
        n = (self.label_at[1:] - self.label_at[:-1])[tokens]
        return self.label_bytes[np.repeat(self.label_at[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that token ids stand for; an id that the vocabulary lacks stands for the replacement character."""
        ids = np.asarray(ids, np.int64)
        token = np.where((ids >= 0) & (ids < len(self.by_id)), self.by_id[np.clip(ids, 0, len(self.by_id) - 1)], -1)
        if len(ids) and token.min() < 0:
            return b"".join(self.labels(np.array([t])).tobytes() if t >= 0 else "\ufffd".encode() for t in token.tolist())
        return self.labels(token).tobytes() if len(ids) else b""


_classes_of: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    if not _classes_of:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        table[_WHITE] = SPACE
        _classes_of.append(table)
    return _classes_of[0]


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of all texts, as byte offsets, and the index of the first word of each text."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return lead, np.zeros(len(offs), np.int64)
    b0 = data[lead].astype(np.int64)
    code = b0.copy()
    for low, high, size, keep in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        pick = np.flatnonzero((b0 >= low) & (b0 < high))
        value = b0[pick] & keep
        for k in range(1, size):
            value = (value << 6) | (data[lead[pick] + k] & 0x3F)
        code[pick] = value
    kind = character_classes()[code]
    n = len(lead)
    fresh_text = np.zeros(n + 1, bool)  # a text begins
    fresh_text[np.searchsorted(lead, offs[:-1][offs[:-1] < offs[1:]])] = True
    fresh_text[n] = True
    begins = fresh_text.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins[:n])
    stop = np.append(run[1:], n)
    run_kind, size = kind[run], stop - run
    start = np.zeros(n, bool)
    start[run] = True
    # White space before something else leaves its last sign to it: a blank goes with the next word.
    before = np.flatnonzero((run_kind == SPACE) & ~fresh_text[stop])
    tail = stop[before] - 1
    start[tail] = True
    blank = code[tail] == 0x20
    joined = stop[before][blank]
    start[joined] = False
    # An apostrophe by itself takes s, t, m, d, re, ve or ll with it.
    alone = np.flatnonzero((run_kind == OTHER) & (size == 1) & (code[run] == 0x27) & start[run] & ~fresh_text[stop])
    alone = alone[kind[np.minimum(stop[alone], n - 1)] == LETTER]
    if len(alone):
        nxt = stop[alone]
        letters = size[alone + 1]
        c1, c2 = code[nxt], np.where(letters > 1, code[np.minimum(nxt + 1, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        take = np.where(one, 1, np.where(two, 2, 0))
        hit = take > 0
        start[nxt[hit]] = False
        rest = hit & (letters > take)
        start[nxt[rest] + take[rest]] = True
    begin = lead[start]
    return begin, np.searchsorted(begin, offs)


def encode_texts(automaton: Automaton, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts: from, to, their tokens (as creation numbers) in turn, and each text's count."""
    for i, j in textvec.pieces(offs, 1 << 21):
        part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        begin, first = split_words(part, at)
        end = np.append(begin[1:], len(part)) if len(begin) else begin
        tokens, n = automaton.encode_spans(part, begin, end)
        total = np.concatenate([[0], np.cumsum(n)])
        yield i, j, tokens, np.diff(total[first])


def compile_vocabulary(path: str = VOCABULARY) -> dict[str, np.ndarray]:
    """All tables of an automaton from a vocabulary file with merges."""
    tokens, ids, parts = read_merges(path)
    state, symbol, arcs, reached = compile_merges(parts)
    keys, to, token = compile_trie(tokens, reached)
    at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    label = np.frombuffer(b"".join(tokens), np.uint8)
    return {"state": state, "symbol": symbol, "arcs": arcs, "keys": keys, "to": to, "token": token, "ids": np.array(ids, np.int64), "label_bytes": label, "label_at": at}


def publish(spark, tables: dict[str, np.ndarray]) -> str:
    """Write the tables to a new folder in the shared one."""
    uri = fresh(spark, "bpe-automaton")
    where, path = open_fs(uri)
    where.create_dir(path, recursive=True)
    for name, table in tables.items():
        raw = io.BytesIO()
        np.save(raw, table)
        with where.open_output_stream(f"{path}/{name}.npy") as out:
            out.write(raw.getbuffer())
    return uri


_published: dict[tuple[str, str], str] = {}


def published(spark, vocabulary: str) -> str:
    """The folder of a vocabulary's automaton, which this driver compiles once for each content of the file and shared folder."""
    with open(vocabulary, "rb") as file:
        key = shared_dir(spark), hashlib.sha256(file.read()).hexdigest()
    uri = _published.get(key)
    if uri is not None:
        where, path = open_fs(uri)
        if where.get_file_info(f"{path}/{Automaton.NAMES[-1]}.npy").type == fs.FileType.File:
            return uri
    _published[key] = publish(spark, compile_vocabulary(vocabulary))
    return _published[key]


_opened: dict[str, Automaton] = {}


def load(uri: str) -> Automaton:
    """The automaton of a folder; a Python worker opens it once, by memory map where the folder is a file system's."""
    if uri not in _opened:
        where, path = open_fs(uri)
        tables = {}
        for name in Automaton.NAMES:
            if isinstance(where, fs.LocalFileSystem):
                tables[name] = np.load(f"{path}/{name}.npy", mmap_mode="r")
            else:
                with where.open_input_file(f"{path}/{name}.npy") as file:
                    tables[name] = np.load(io.BytesIO(file.read()))
        small = {k: np.array(v) if k != "arcs" else v for k, v in tables.items()}
        _opened.clear()
        _opened[uri] = Automaton(small)
    return _opened[uri]


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip): the ids of each whole text, and whether their decoding gives its bytes again."""
    uri = published(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(uri)
        for batch in batches:
            data, offs = textvec.utf8(batch.column(1))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for i, j, tokens, n in encode_texts(automaton, data, offs):
                same = np.zeros(j - i, bool)
                begin = np.concatenate([[0], np.cumsum(n)])
                back = automaton.labels(tokens)
                part = data[offs[i] : offs[j]]
                size = np.concatenate([[0], np.cumsum((automaton.label_at[1:] - automaton.label_at[:-1])[tokens])])[begin]
                if len(back) == len(part):
                    wrong = np.concatenate([[0], np.cumsum(back != part)])
                    own = offs[i : j + 1] - offs[i]
                    same = (size[:-1] == own[:-1]) & (size[1:] == own[1:]) & (wrong[own[1:]] == wrong[own[:-1]])
                gone = null[i:j]
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32(), mask=np.append(gone, False)), pa.array(automaton.ids[tokens], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64(), mask=gone), lists, pa.array(same, mask=gone)], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(encode, "doc_id long, n_tokens long, tokens array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, uri: str, *, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) from token ids, by the automaton published at `uri`; bytes that aren't UTF-8 become the replacement character."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(uri)
        for batch in batches:
            texts = [None if t is None else automaton.decode(np.array(t, np.int64)).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).alias("tokens")).mapInArrow(decode, "doc_id long, text string")
