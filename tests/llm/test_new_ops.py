"""Operators 11 to 13 against the library, brute force and numpy, and on odd, repeated and empty input."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_ops import FOLDER, LONG, ODD, documents, empty, odd, ready  # noqa: F401
from tidekeep.llm import feast_whitening, periodic_runs, queries, tree_concat

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# ---- 11: tree concatenation ----

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoding_digests(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_tree_gives_the_ids_of_whole_texts(ready, documents, library):
    rows = queries.op11_tree_concat(ready, FOLDER).collect()
    assert sorted(map(tuple, rows), key=str) == encoding_digests(library, [(d.doc_id, d.text) for d in documents])


def test_tree_of_odd_rows(odd, empty, library):
    for leaf, spread in ((2048, 1 << 16), (7, 50)):
        encoded = tree_concat.encode(odd[0], PATH, leaf=leaf, spread=spread)
        found = tree_concat.digests(tree_concat.decode(encoded, PATH)).collect()
        assert sorted(map(tuple, found), key=str) == encoding_digests(library, odd[1])
    assert tree_concat.decode(tree_concat.encode(empty, PATH), PATH).collect() == []


def test_tree_of_unsplit_texts(library):
    coder, rng = tree_concat.Coder(PATH, limit=50), random.Random(7)
    parts = ["abc", "a", "'re", "'r", "'", "''", "s", "'ll", "é", "é", "İ", "ß", " ", "\n", "\x1c", "1", "٣", "!!", "<|endoftext|>",
             "</w>", "中", "😀", "x" * 30, "lorem", "ing", "tion", "Σ", "̖", "'VE", "\xa0"]
    for k in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(100)))
        if k % 3 == 0:
            text = "".join(rng.choice("ab'ert!") for _ in range(rng.randrange(400)))
        if k % 7 == 0:
            text = rng.choice(["x", "ab", "aab", "the", "!", "é"]) * rng.randrange(1, 700)
        found = coder.encode_texts([text], leaf=rng.choice([1, 5, 17, 40]))[0].tolist()
        assert found == library.encode(text, add_special_tokens=False).ids, text


def test_tree_uses_ids_of_both_sides(monkeypatch):
    coder = tree_concat.Coder(PATH)
    seen = []
    windows = coder.windows
    monkeypatch.setattr(coder, "windows", lambda parts: seen.extend(parts) or windows(parts))
    coder.encode_texts(["pneumonoultramicroscopicsilicovolcanoconiosis" * 2000], leaf=2048)
    assert seen and max(map(len, seen)) <= 8 * tree_concat.REACH  # the joins read little of the text


# ---- 12: periodic runs ----

def brute_runs(words, least=6, power=4):
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, power * q):
                part = words[i:i + length]
                if not any(part[d:] == part[:length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_digests(rows):
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words) if n < 60_000 else [(0, n, 3)]  # the long text repeats three words
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        out.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                    sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
                    sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=str)


def test_runs(ready, documents):
    docs = [d for d in documents if len(d.text) < 20_000]
    frame = ready.createDataFrame([(d.doc_id, d.text) for d in docs], "doc_id long, text string")
    found = periodic_runs.digests(periodic_runs.find(periodic_runs.planted(frame))).collect()
    assert sorted(map(tuple, found), key=str) == run_digests([(d.doc_id, d.text) for d in docs])
    assert {r.doc_id for r in queries.op12_periodic_runs(ready, FOLDER).collect()} == {d.doc_id for d in documents}


def test_runs_of_odd_rows(odd, empty):
    rows = [(i, t) for i, t in odd[1] if t != LONG or zlib.crc32(str(i).encode()) % 10]
    found = periodic_runs.digests(periodic_runs.find(periodic_runs.planted(odd[0]))).collect()
    assert sorted(map(tuple, found), key=str) == run_digests(rows)
    assert periodic_runs.digests(periodic_runs.find(periodic_runs.planted(empty))).collect() == []


def test_tree_runs_against_brute_force():
    rng = random.Random(3)
    for k in range(1500):
        kinds, n, words = rng.choice([1, 2, 3, 5]), rng.randrange(70), []
        while len(words) < n:
            words += [rng.randrange(kinds) for _ in range(rng.randrange(1, 6))] * (rng.randrange(1, 8) if k % 2 else 1)
        for least, power in ((6, 4), (2, 2)):
            wanted = brute_runs(words, least, power)
            assert [tuple(r) for r in periodic_runs.tree_runs(words, least, power).tolist()] == wanted
            assert [tuple(r) for r in periodic_runs.runs_of(words, least, power).tolist()] == wanted


def test_common_extensions():
    rng = random.Random(5)
    for kinds, n in ((1, 300), (2, 5000), (3, 20_000)):
        words = [rng.randrange(kinds) for _ in range(n // 2)] * 2
        tree = periodic_runs.SuffixTree(words)
        pairs = [rng.sample(range(n), 2) for _ in range(200)]
        found = tree.lce(*np.array(pairs).T)
        for (a, b), common in zip(pairs, found.tolist()):
            same = next((k for k in range(n - max(a, b)) if words[a + k] != words[b + k]), n - max(a, b))
            assert common == same


# ---- 13: whitening ----

def plain_whitening(vectors, wanted=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    y = (n * x - x.sum(axis=0)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    kept = [k for k in range(len(values))[::-1] if values[k] > 1e-12 * values.sum()][:wanted]
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - x.sum(axis=0)]
    return deviation, y @ vectors[:, kept] / np.sqrt(values[kept]), values[kept] / values.sum()


def check_whitening(rows, ids, vectors):
    deviation, whitened, explained = plain_whitening(vectors)
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(found) == whitened.size
    got = np.array([[found[i, k + 1].whitened for k in range(whitened.shape[1])] for i in ids])
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * sign - whitened).max() < 1e-7
    assert {r.n for r in rows} == {len(vectors)}
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9
    for i, d in zip(ids, deviation):
        for k, e in enumerate(explained):
            assert found[i, k + 1].deviation == d and abs(found[i, k + 1].explained / e - 1) < 1e-9


def test_whitening(ready):
    rows = ready.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    check_whitening(queries.op13_feast_whitening(ready, FOLDER).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


SCHEMA = "vec_id long, n string, embedding array<float>, deviation int, whitened string, vector string, at int"


def whitened(ready, rows):
    df = ready.createDataFrame([(i, "n", v, 1, "w", "v", 2) for i, v in rows], SCHEMA)
    return feast_whitening.by_component(feast_whitening.whiten(df)).collect()


def test_whitening_of_odd_rows(ready):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((40, 5)).astype(np.float32).tolist()
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4),
           (105, [1.0, 2.0]), (106, [None])]
    rows = list(enumerate(good))
    check_whitening(whitened(ready, [*rows, *bad]), list(range(40)), good)
    twice = whitened(ready, [*rows, *rows, (None, good[0])])
    assert len(twice) == 81 * 5 and {r.n for r in twice} == {81}
    assert sum(r.vec_id is None for r in twice) == 5
    # Low rank: only components with variance; no variance or no rows: none.
    flat = [[float(x), float(2 * x), 0.0] for x in range(20)]
    check_whitening(whitened(ready, list(enumerate(flat))), list(range(20)), flat)
    assert whitened(ready, [(1, [1.0, 2.0])] * 3) == [] and whitened(ready, bad[:2]) == [] and whitened(ready, []) == []
    huge = whitened(ready, [(1, [1e38, 0.0]), (2, [-1e38, 0.0]), (3, [0.0, 1.0])])
    assert {r.deviation for r in huge} == {None} or all(r.deviation is not None for r in huge if r.vec_id == 3)


def test_components_of_hard_spectra(ready):
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    for values in (0.7 ** np.arange(60), np.r_[np.ones(40), np.full(20, 0.5)], np.r_[5, 5, 5, np.ones(57)], 1 + 1e-9 * np.arange(60)):
        matrix = turn * values @ turn.T
        matrix = (matrix + matrix.T) / 2
        found, vectors = feast_whitening.components(ready, matrix)
        assert np.abs(found - np.sort(values)[::-1][:32]).max() < 1e-10
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10
        assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
        for shift in (0.1, 0.6, 2.0):
            assert feast_whitening.inertia(matrix, shift) == (values > shift).sum()
