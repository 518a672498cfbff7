import json
import random

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import bpe, textvec

TEXTS = [
    "", "a", "don't I'll they've we're 's 'S ''s x's  'tis\n'there", "a  b   c \n\n d\t\te  ", "aaaaaaaaaaaaaaaa aaaa aaaaaaa", "日本語テスト ½²³ 123abc",
    "<|endoftext|> hello", "x" * 300 + " " * 200 + "!" * 100, "é ñ ß Å", "\x1c\x1d a\x85b　 c", "'re're'll 'd'd's'", "ab" * 4000, "tab\tand\r\nline ends \n",
]


def brute_bpe(raw, ranks):
    """Merge the best-ranked neighbours, leftmost first, until none is left."""
    parts = [bytes([b]) for b in raw]
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 10**9:
            break
        pair, out, i = (parts[at], parts[at + 1]), [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def tables_of(merges):
    tokens = [bytes([b]) for b in range(256)]
    at = {t: i for i, t in enumerate(tokens)}
    parts = []
    for a, b in merges:
        parts.append((at[a], at[b]))
        at[a + b] = len(tokens)
        tokens.append(a + b)
    state, symbol, arcs, reached = bpe.compile_merges(parts)
    keys, to, token = bpe.compile_trie(tokens, reached)
    return {"state": state, "symbol": symbol, "arcs": arcs, "keys": keys, "to": to, "token": token, "ids": np.arange(len(tokens)), "label_bytes": np.frombuffer(b"".join(tokens), np.uint8), "label_at": np.concatenate([[0], np.cumsum([len(t) for t in tokens])])}, tokens


@pytest.mark.parametrize("seed", range(12))
def test_random_merges_match_brute_force(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abc"
    known, merges = [bytes([b]) for b in letters], []
    while len(merges) < 25:
        pair = (rng.choice(known), rng.choice(known))
        if pair[0] + pair[1] not in known:
            merges.append(pair)
            known.append(pair[0] + pair[1])
    tables, tokens = tables_of(merges)
    automaton, ranks = bpe.Automaton(tables), {m: i for i, m in enumerate(merges)}
    for _ in range(300):
        raw = bytes(rng.choice(letters) for _ in range(rng.randint(1, 24)))
        table = np.frombuffer(raw, np.uint8)[None, :]
        for run in (automaton.run, automaton._each):
            got, n = run(table)
            assert [tokens[t] for t in got] == brute_bpe(raw, ranks) and n.tolist() == [len(got)]


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(bpe.compile_vocabulary())


def encoded(automaton, texts):
    data, offs = textvec.utf8(pa.array(texts))
    out = []
    for _, _, tokens, n in bpe.encode_texts(automaton, data, offs):
        out += np.split(automaton.ids[tokens], np.cumsum(n)[:-1])
    return [x.tolist() for x in out]


def test_public_vocabulary_matches_its_library(automaton):
    from tokenizers import Tokenizer

    rng = random.Random(0)
    signs = "ab é'sStT\n\t 0½.,!?ßж日🙂’re ll"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    library = Tokenizer.from_file(bpe.VOCABULARY)
    library.encode_special_tokens = True
    got = encoded(automaton, texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [automaton.decode(g).decode() for g in got] == texts


def test_documents_round_trip(spark):
    rows = [(i, t, None, "x") for i, t in enumerate(TEXTS)] + [(50, None, None, None), (None, "null id", 1, None), (1, "a", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int, n_tokens string")
    out = bpe.encode_documents(docs)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for k, t, *_ in rows if k == r.doc_id)
        assert (r.tokens is None and r.n_tokens is None and r.round_trip is None) if text is None else (len(r.tokens) == r.n_tokens and r.round_trip)
    uri = bpe.publish(spark, bpe.compile_vocabulary())
    back = {r.doc_id: r.text for r in bpe.decode_documents(out, uri).collect()}
    assert back == {k: t for k, t, *_ in rows}
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_vocabulary_file_is_a_parameter(tmp_path):
    alphabet = {b: c for c, b in bpe.byte_alphabet().items()}
    vocab = {alphabet[b]: b for b in range(256)} | {"ab": 300}
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["a b"]}}))
    automaton = bpe.Automaton(bpe.compile_vocabulary(str(path)))
    assert encoded(automaton, ["abba"]) == [[300, 98, 97]]
