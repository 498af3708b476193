"""Scores by context mixing against counts in plain dictionaries, and words and contexts beyond any fixed number."""

import collections

import numpy as np
import pytest

from tests.llm.test_ops import frame, ready  # noqa: F401
from tidekeep.llm import context_mixing as mixing


def plain_scores(documents):
    """All counts by (context, bits of the path so far) in one dictionary."""
    texts = [(i, t.encode().lower().split() + [mixing.END]) for i, t in documents]
    seen = collections.Counter(w for i, words in texts if not mixing.held_out(i) for w in words)
    classes = collections.defaultdict(list)
    for w in sorted(seen):
        if w != mixing.END:
            classes[seen[w]].append(w)
    names = [None, *sorted((k for k in classes if k > 1), reverse=True), 1]
    tree = mixing.Tree([seen[mixing.END] + 1, *(k * len(classes[k]) for k in names[1:-1]), 2 * len(classes[1]) + 1])

    def path(word):  # bit, chance of a one, whether contexts count
        kind = None if word == mixing.END else max(1, seen[word])
        k = names.index(kind)
        at = slice(tree.start[k], tree.start[k] + tree.length[k])
        out = [(int(b), tree.chance[n], True) for n, b in zip(tree.node[at], tree.bit[at])]
        if kind == 1:
            out.append((int(not seen[word]), 0.5, False))
        members = classes[kind] if seen[word] else []
        while len(members) > 1:
            half = (len(members) + 1) // 2
            bit = word in members[half:]
            out.append((int(bit), (len(members) - half) / len(members), True))
            members = members[half:] if bit else members[:half]
        return out

    paths, counts = {w: path(w) for _, words in texts for w in words}, collections.Counter()

    def decisions(words, i):
        before = (words[i - 1] if i else None), (words[i - 2] if i > 1 else None)
        so_far = ""
        for bit, chance, told in paths[words[i]]:
            yield bit, chance, told, (before[:1], so_far), (before, so_far)
            so_far += str(bit)

    for i, words in texts:
        if not mixing.held_out(i):
            for k in range(len(words)):
                for bit, _, told, one, two in decisions(words, k):
                    counts.update([(*one, bit), (*two, bit)] if told else [])
    spelled = collections.Counter()

    def letters(word):
        data = b"\0\0\0" + word + b"\0"
        for k in range(3, len(data)):
            so_far = ""
            for bit in f"{data[k]:08b}":
                yield int(bit), (data[k - 2:k], so_far), (data[k - 3:k], so_far)
                so_far += bit

    for w in seen:
        for bit, two, three in letters(w) if w != mixing.END else ():
            spelled.update([(two, bit), (three, bit)])

    def inputs(found, chance, get):
        n = np.arange(len(found))
        tables = np.array([[get(f[k], b) for k in (-2, -1) for f in found] for b in (0, 1)], float)
        return mixing._inputs(np.array(chance), tables, (n, n + len(n)))

    out = {}
    for i, words in texts:
        mixer, score = mixing.Mixer(1), 0.0
        for a in range(0, len(words), mixing.STEP):
            found = [d for k in range(a, min(len(words), a + mixing.STEP)) for d in decisions(words, k)]
            x, gate = inputs(found, [d[1] for d in found], lambda key, b: counts[*key, b])
            score += mixer.cost(np.zeros(len(found), int), x, gate, np.array([d[0] for d in found])).sum()
        for w in words:
            if not seen[w] and w != mixing.END:
                found = list(letters(w))
                x, gate = inputs(found, [0.5] * len(found), lambda key, b: spelled[key, b])
                p = 1 / (1 + np.exp(-np.clip(np.einsum("kn,nk->n", x, mixing._START[gate]), -16, 16)))
                score += np.log10(np.where([d[0] for d in found], p, 1 - p)).sum()
        out[i] = score
    return out


@pytest.mark.parametrize("hot", [3, 1 << 19])
def test_scores_with_all_counts(ready, hot):  # noqa: F811
    rng = np.random.default_rng(5)
    words = [f"w{i}é" for i in range(900)]
    documents = [(i, " ".join(words[int(900 * x ** 3)] for x in rng.random(rng.integers(0, 120)))) for i in range(120)]
    rows = mixing.scores(frame(ready, documents), block_tokens=700, hot=hot).collect()
    wanted = plain_scores(documents)
    assert len(rows) == len(documents)
    assert all(abs(r.score - wanted[r.doc_id]) < 1e-6 * max(1, abs(wanted[r.doc_id])) for r in rows)


def test_every_word_has_contexts(ready):  # noqa: F811
    """Each of 6,000 words is followed by its own partner; also the rarest must be known to predict it."""
    words = [f"a{i}" for i in range(6000)]
    train = [i for i in range(400) if not mixing.held_out(i)]
    pairs = " ".join(f"{w} b{w}" for w in words)
    first, second = [i for i in range(400, 600) if mixing.held_out(i)][:2]
    documents = [(train[0], pairs), (train[1], pairs), (first, " ".join(f"{w} b{w}" for w in words[5000:])),
                 (second, " ".join(f"{w} b{v}" for w, v in zip(words[5000:], words[4000:])))]
    score = {r.doc_id: r.score for r in mixing.scores(frame(ready, documents), block_tokens=2000).collect()}
    assert score[first] > 0.8 * score[second]


def test_words_of_several_ranges(ready):  # noqa: F811
    """Blocks with more words than a piece holds, so words of a class are numbered over several ranges."""
    rng = np.random.default_rng(6)
    words = [f"{i * 7919 % 10007:x}ß{i}" for i in range(9000)]
    documents = [(i, " ".join(words[k] for k in rng.integers(0, 9000, 400))) for i in range(40)]
    docs = frame(ready, documents).coalesce(1)
    pieces = mixing.encode_blocks(docs, 8000).where("pos >= 0")
    assert pieces.groupBy("block").count().where("count > 1").count() > 0
    wanted = plain_scores(documents)
    rows = mixing.scores(docs, block_tokens=8000).collect()
    assert len(rows) == len(documents)
    assert all(abs(r.score - wanted[r.doc_id]) < 1e-6 * max(1, abs(wanted[r.doc_id])) for r in rows)


def test_words_of_a_block_take_few_rows(ready):  # noqa: F811
    """Words go through the shuffle packed: a block of 20,001 different words has no row for each."""
    blocks = mixing.encode_blocks(frame(ready, [(1, " ".join(f"w{i}" for i in range(20_000)))])).collect()
    assert len(blocks) < 20
    assert sum(len(bytes(x)) for r in blocks if r.pos >= 0 for x in (r["sizes"], r["words"], r["n"])) < 5 * 20_001


def test_answers_leave_out_what_a_block_knows(ready):  # noqa: F811
    """No two blocks have a word in common, so no answer has more than a few bytes, however many pairs were asked."""
    train = [i for i in range(60) if not mixing.held_out(i)][:4]
    documents = [(i, " ".join(f"{'abcd'[k]}{j * j % 701}" for j in range(3000))) for k, i in enumerate(train)]
    blocks = mixing.encode_blocks(frame(ready, documents).coalesce(1), 2000).collect()
    words = {}
    for r in (r for r in blocks if r.pos >= 0):
        found, n = mixing.unpacked_words(r["sizes"], r["words"], r.m).to_pylist(), mixing.unpacked(r["n"], "<u4", r.m)
        for w, k in zip(found, n.tolist()):
            words[w] = words.get(w, 0) + k
    end = words.pop(mixing.END)
    kinds = sorted(set(words.values()), reverse=True)
    sizes = [sum(k == n for n in words.values()) for k in kinds] + ([0] if kinds[-1] > 1 else [])
    kinds += [1] if kinds[-1] > 1 else []
    code = mixing.Code(mixing.Tree([end + 1, *(k * n + 1 for k, n in zip(kinds, sizes))]), [1, *(max(1, n) for n in sizes)], [end, *kinds])
    ids = {mixing.END: int(code.first[0])}
    for w in sorted(words):
        k = 1 + kinds.index(words[w])
        ids[w] = int(code.first[k]) + sum(words.get(v) == words[w] for v in ids)
    rows = [(r.block, bytes(r["row"])) for r in blocks if r.pos < 0]
    for r in (r for r in blocks if r.pos >= 0):
        mine = np.array([ids[w] for w in mixing.unpacked_words(r["sizes"], r["words"], r.m).to_pylist()], np.uint32)
        rows.append((r.block, mixing.struct.pack("<biii", 1, r.pos, r.m, 0) + mixing._sized(mixing.packed(mine)) + mixing._sized(mixing.packed(np.zeros(0)))))
    known = ready.sparkContext._jsc.broadcast(mixing._model(code, end + sum(words.values()), 1 + len(words), 1 << 19, 0))
    ask = mixing._kernel(ready, "Ask", known, "array<struct<chunk int, row binary>>")
    answer = mixing._kernel(ready, "Answer", known, "array<struct<block bigint, row binary>>")
    listed = lambda df, key: df.groupBy(key).agg(mixing.F.collect_list("row").alias("rows"))
    asked = listed(ready.createDataFrame(rows, "block long, row binary"), "block").select(mixing.F.explode(ask("rows")).alias("r")).select("r.*").cache()
    answers = listed(asked, "chunk").select(mixing.F.explode(answer("rows")).alias("r")).select("r.*").collect()
    assert len({r.block for r in answers}) == 4 and sum(len(r["row"]) for r in asked.collect()) > 4000
    assert max(len(r["row"]) for r in answers) < 64


def test_packed_numbers():
    rng = np.random.default_rng(7)
    for most in (1, 63, 64, 255, 256, 5000, 1 << 20, (1 << 32) - 1):
        for n in (0, 1, 3000):
            numbers = (rng.random(n) ** 3 * most).astype(np.uint32)
            numbers[:1] = most
            assert np.array_equal(mixing.unpacked_ranks(mixing.packed_ranks(numbers), n), numbers)
            assert np.array_equal(mixing.unpacked(mixing.packed(numbers), "<u4", n), numbers)
    steps = np.array([5, -3, 0, 1 << 40, -(1 << 62)])
    assert np.array_equal(mixing.unpacked(mixing.packed(steps), "<i8", 5), steps)
