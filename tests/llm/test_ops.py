"""Operators against brute force on small tables, and on empty, odd, repeated and very long input."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as registered
import corpus_pipeline
from check import compare
from tidekeep.llm import (base, bottomk, context_mixing, divergence, dom_boosting, harmonic_packing, near_copies, queries,
                          repair_ids, simhash_grid, tiktoken_codec, winnowing, wordpiece_lengths)
from tidekeep.llm.components import components

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000
ODD = [None, "", " ", "\n\n", "one", "  two  spaces ", "tab\tand\nline", "é É ß Ǆ İ Σς ﬀ", "中文 text 中文, ok", "<|endoftext|> x",
       "don't we'LL x' 's", "a b c d e", "a b c d e", "x" * 70_000, LONG, "word .​ ​x \x85 \x1c", "\U0001f600 ok 1234 12,3"]
CLASHING = "doc_id long, text string, lang string, start long, slots int, block long, pos int, kept boolean, fp long, deleted string, " \
           "place int, row string, quality string, _id long, sequence_id long"


@pytest.fixture(scope="module")
def ready(spark):
    return queries.ready(spark)


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return queries.materialize(spark.createDataFrame([
        (i, t, "en" if n % 2 else None, 1, 2, 3, 4, True, 5, "x", 6, "r", "q", 7, 8) for n, (i, t) in enumerate(rows)], CLASHING), "odd")


@pytest.fixture(scope="module")
def odd(ready):
    rows = [*enumerate(ODD), (None, "null id"), (3, "\n\n"), (3, "\n\n"), (4, "same id, other text"), (None, None)]
    return frame(ready, rows), rows


@pytest.fixture(scope="module")
def empty(ready):
    return frame(ready, [(1, "x")]).limit(0)


@pytest.fixture(scope="module")
def documents(ready):
    return ready.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()


def rows_of(name, spark):
    return queries.queries()[name](spark, FOLDER).collect()


def tokenizer(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def plain_ids(coder, text, end):
    return np.array(coder.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


# ---- encoding ----

@pytest.mark.parametrize("name,end", [("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 0)])
def test_chunks_give_the_ids_of_whole_texts(name, end, documents):
    coder = base.ChunkEncoder(public_tokenizers.path(name), limit=300)  # forgets often
    whole = tokenizer(name)
    texts = [t or "" for t in ODD] + [d.text for d in documents[:60]]
    for a in range(0, len(texts), 7):
        ids, bounds = coder.encode(texts[a:a + 7], end)
        for k, text in enumerate(texts[a:a + 7]):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == plain_ids(whole, text, end).tolist(), text[:50]


# ---- 1: packing ----

def check_packing(rows, expected):
    sequences, found = collections.defaultdict(list), collections.Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    for r in rows:
        found[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    wanted = collections.Counter()
    for doc, ids in expected:
        at = 0
        for length in harmonic_packing.cut_lengths(len(ids)):
            wanted[doc, at, length, zlib.crc32(ids[at:at + length].tobytes()), len(ids)] += 1
            at += length
        assert at == len(ids)
    assert found == wanted
    return sum(r.length for r in rows) / 4096 / max(1, len(sequences))


def test_packing(ready, documents):
    coder = tokenizer("word_bpe_49k.json")
    fill = check_packing(rows_of("op1_harmonic_packing", ready), [(d.doc_id, plain_ids(coder, d.text, 2)) for d in documents])
    assert fill > 0.95


def test_packing_of_odd_rows(odd, empty):
    coder = tokenizer("word_bpe_49k.json")
    check_packing(queries.packed(odd[0]).collect(), [(i, plain_ids(coder, t, 2)) for i, t in odd[1]])
    assert queries.packed(empty).collect() == []


def test_cuts_fit_their_class():
    for n in [*range(1, 4200), 8191, 8192, 100_000]:
        cut = harmonic_packing.cut_lengths(n)
        assert sum(cut) == n and max(cut) <= 4096
        assert all(4096 - (4096 // length) * length <= 64 for length in cut)


def test_packing_classes_over_workers(ready):
    rows = [(i, 0, 1365, 1365) for i in range(2000)] + [(i, 0, 4096, 4096) for i in range(700)] + [(i, 0, 7, 7) for i in range(1300)]
    placed = harmonic_packing.place(ready.createDataFrame(rows, "doc_id long, start long, length long, doc_tokens long").repartition(16)).collect()
    bins = collections.Counter((r.sequence_id, r.slots) for r in placed)
    assert sum(n == 3 for (_, k), n in bins.items() if k == 3) == 666
    assert len({r.sequence_id for r in placed}) <= 700 + 667 + 3


# ---- 2: shards of ids ----

def check_shards(rows, expected):
    at, wanted = 0, []
    for doc, ids in expected:
        wanted.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == wanted


def test_shards(ready, documents):
    coder = tokenizer("byte_bpe_50k.json")
    check_shards(rows_of("op2_repair_ids", ready), [(d.doc_id, plain_ids(coder, d.text, 0)) for d in documents])


def test_shards_of_odd_rows(ready, odd, empty):
    coder = tokenizer("byte_bpe_50k.json")
    order = sorted(odd[1], key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    path = public_tokenizers.path("byte_bpe_50k.json")
    for frame_, rows, size in ((odd[0], order, 500), (odd[0], order, 1 << 20), (empty, [], 10)):
        folder = repair_ids.shard_folder(ready)
        repair_ids.write_shards(frame_, folder, path, 0, 50_257, shard_ids=size)
        check_shards(repair_ids.read_shards(ready, folder).collect(), [(i, plain_ids(coder, t, 0)) for i, t in rows])


def test_random_access_and_compression(ready, documents):
    coder = tokenizer("byte_bpe_50k.json")
    folder = repair_ids.shard_folder(ready)
    repair_ids.write_shards(ready.read.parquet(f"{FOLDER}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), 0, 50_257)
    shard = max(ready.read.parquet(folder).collect(), key=lambda r: r["n_tokens"])
    texts = {d.doc_id: d.text for d in documents}
    assert len(shard["symbols"]) // 3 < 0.9 * shard["n_tokens"]
    for i in (0, len(shard["doc_ids"]) // 2, len(shard["doc_ids"]) - 1):
        ids = plain_ids(coder, texts[shard["doc_ids"][i]], 0).tolist()
        assert repair_ids.decode_document(shard, i).tolist() == ids
        for position in {0, len(ids) // 3, len(ids) - 1}:
            assert repair_ids.locate(shard, i, position) == ids[position]


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice([0, 1, 2, 3, 50_256], rng.integers(1, 4000)).astype(np.uint32)
    ends = rng.random(len(ids)) < 0.02
    ends[-1] = True
    symbols, after, left, right = repair_ids.compress(ids, ends, 50_257, min_count=2)
    assert repair_ids.expand(symbols, left, right, 50_257).tolist() == ids.tolist()
    sizes = repair_ids.expansions(left, right, 50_257)
    widths = np.where(symbols < 50_257, 1, sizes[np.maximum(symbols - 50_257, 0)] if len(sizes) else 1)
    assert np.cumsum(widths)[after].tolist() == (np.flatnonzero(ends) + 1).tolist()


def test_a_rare_pair_does_not_block_a_frequent_one():
    """Pairs that share a slot in the first round, of which the rare one is met first."""
    def slot(a, b):
        return (((a << 32) | b) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 40 & ((1 << repair_ids.SLOT_BITS) - 1)

    wanted = slot(1, 2)
    rare = next((a, b) for a in range(1000, 4000) for b in range(1000, 2000) if slot(a, b) == wanted)
    ids = np.array([*rare, 9000, *[x for i in range(40) for x in (1, 2, 10_000 + i)]], np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    symbols, _, left, right = repair_ids.compress(ids, ends, 50_257)
    assert (1, 2) in zip(left.tolist(), right.tolist())
    assert repair_ids.expand(symbols, left, right, 50_257).tolist() == ids.tolist()


# ---- 3: tiktoken ----

def test_tiktoken(ready, documents, odd, empty):
    coder = tiktoken_codec.load(RANKS, public_tokenizers.PATTERN)

    def expected(text):
        ids = np.array(coder.encode_ordinary(text or ""), "<u4")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert collections.Counter(map(tuple, rows_of("op3_tiktoken_codec", ready))) == collections.Counter(
        (d.doc_id, *expected(d.text)) for d in documents)
    for frame_, rows in ((odd[0], odd[1]), (empty, [])):
        encoded = tiktoken_codec.encode(frame_, RANKS, public_tokenizers.PATTERN)
        found = tiktoken_codec.digests(tiktoken_codec.decode(encoded, RANKS, public_tokenizers.PATTERN)).collect()
        assert collections.Counter(map(tuple, found)) == collections.Counter((i, *expected(t)) for i, t in rows)


@pytest.mark.parametrize("text", [LONG, "a" * 300, "x  y " * 50, " lead", "trail ", "it's  'll\n\n x" * 30])
def test_parts_are_cut_where_matches_end(text):
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken_codec.load(
        RANKS, public_tokenizers.PATTERN)._mergeable_ranks, special_tokens={})
    for size in (1, 5, 40, 1000):
        parts = tiktoken_codec.parts(text[:3000], size)
        assert "".join(parts) == text[:3000]
        assert [i for p in parts for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text[:3000])


# ---- 4 and 5: quality and lines, also held against SQL ----

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(ready, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    text, good = compare(ready, con, FOLDER, name, queries.queries()[name], queries.oracle_sql()[name])
    assert good, text


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_native_plans_have_no_python(ready, name):
    df = queries.queries()[name](ready, FOLDER)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def measures(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again),
            len(words) < 50 or 100 * len(again) > 50 * len(words))


def test_quality_of_odd_rows(odd, empty):
    measured = queries.materialize(divergence.measure(odd[0]), "measured")
    judged = divergence.judge(measured, divergence.references(measured)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collections.Counter((r.row.doc_id, *(r.quality[c] for c in names)) for r in judged) == collections.Counter(
        (i, *measures(t)) for i, t in odd[1])
    assert not any(r.kept for r in judged if r.quality.base_failed)
    measured = queries.materialize(divergence.measure(empty), "measured")
    assert divergence.judge(measured, divergence.references(measured)).collect() == []


def test_quality_labels(ready):
    verdicts = {r.doc_id: r for r in rows_of("op4_divergence", ready)}
    labels = ready.read.parquet(f"{FOLDER}/labels.parquet").collect()
    judged = [(r.quality, verdicts[r.doc_id].kept) for r in labels if r.doc_id in verdicts and not verdicts[r.doc_id].base_failed]
    assert all(kept for quality, kept in judged if quality == 1)
    assert sum(kept for quality, kept in judged if quality == 0) <= 0.3 * sum(quality == 0 for quality, _ in judged)


def brute_lines(rows, t):
    """Rows in order of place: text and deleted lines of each."""
    ahead, behind, out = set(), set(), []
    for text in rows:
        all_lines = (text or "").split("\n")
        lines = [(i, x, len(WORD.findall(x))) for i, x in enumerate(all_lines) if WORD.search(x)]
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(x[2] for x in lines[a:b + 1]) >= t:
                    key = tuple(x[1] for x in lines[a:b + 1])
                    gone |= {x[0] for x in lines[a:b + 1]} if key in ahead else set()
                    ahead.add(key)
                    break
        for b in range(len(lines)):
            for a in range(b, -1, -1):
                if sum(x[2] for x in lines[a:b + 1]) >= t:
                    key = tuple(x[1] for x in lines[a:b + 1])
                    gone |= {lines[b][0]} if key in behind else set()
                    behind.add(key)
                    break
        out.append((text if not gone else "\n".join(x for i, x in enumerate(all_lines) if i not in gone), len(all_lines), len(gone)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(ready, seed):
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"w{rng.integers(50)}" for _ in range(rng.integers(1, 6))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(1, 30)))) for i in range(60)]
    found = winnowing.drop_repeated_runs(frame(ready, rows), t=9).collect()
    assert {r.row.doc_id: (r.text, r.n_lines, r.n_deleted) for r in found} == dict(zip(range(60), brute_lines([t for _, t in rows], 9)))


def test_a_run_is_deleted_if_and_only_if_a_brute_search_finds_it_earlier(ready):
    rng = np.random.default_rng(9)
    pool = [" ".join(f"w{j}{k}" for k in range(n)) for j, n in enumerate((1, 2, 3, 4, 5, 7))]
    texts = ["\n".join(pool[j] for j in rng.integers(0, len(pool), 14)) for _ in range(25)]
    found = {r.row.doc_id: r for r in winnowing.drop_repeated_runs(frame(ready, list(enumerate(texts))), t=9).collect()}
    seen, t = set(), 9
    for i, text in enumerate(texts):  # all runs of t words or more, not only minimal windows
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(lines[a:b + 1])
                if sum(len(x.split()) for x in run) >= t and (run in seen or any(
                        tuple(lines[c:c + len(run)]) == run for c in range(a))):
                    gone |= set(range(a, b + 1))
        assert found[i].text == ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
        seen |= {tuple(lines[a:b + 1]) for a in range(len(lines)) for b in range(a, len(lines))}


def test_lines_of_odd_rows(odd, empty):
    found = winnowing.drop_repeated_runs(odd[0]).collect()
    assert collections.Counter((r.row.doc_id, r.text, r.n_deleted) for r in found) == collections.Counter((i, t, 0) for i, t in odd[1])
    assert winnowing.drop_repeated_runs(empty).collect() == []


def test_repeated_rows_are_one_document(ready):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(2, f"b\n{passage}"), (1, f"a\n{passage}"), (1, f"a\n{passage}"), (None, passage)]
    found = winnowing.drop_repeated_runs(frame(ready, rows)).collect()
    assert sorted((r.row.doc_id or 9, r.text) for r in found) == [(1, f"a\n{passage}"), (1, f"a\n{passage}"), (2, "b"), (9, "")]


# ---- 6: sketches ----

def shingles(text, width=5):
    words = WORD.findall(text or "")
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_next(rows, documents):
    order = sorted(documents, key=lambda d: (d[0] is None, -(d[0] or 0), (d[1] or "").encode()))
    wanted = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        wanted.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(shingles(text), shingles(edited)),
                       alike(shingles(text), shingles(after))))
    found = collections.defaultdict(list)
    for r in rows:
        found[r.doc_id, r.n_chars, r.edited_sha256].append((r.near_edited, r.near_next))
    assert len(rows) == len(wanted)
    errors = []
    for doc, n, sha, x, y in wanted:
        match = min(found[doc, n, sha], key=lambda m: abs(m[0] - x) + abs(m[1] - y))
        found[doc, n, sha].remove(match)
        errors += [abs(match[0] - x), abs(match[1] - y)]
    return errors


def test_sketches(ready, documents):
    rows = rows_of("op6_bottomk", ready)
    errors = check_next(rows, [(d.doc_id, d.text) for d in documents])
    assert max(errors) < 0.2 and np.mean(errors) < 0.02
    texts = {d.doc_id: d.text for d in documents}
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_sketches_of_odd_rows(ready, odd, empty):
    assert max(check_next(bottomk.with_next(odd[0]).collect(), odd[1])) < 0.2
    assert bottomk.with_next(empty).collect() == []
    assert max(check_next(bottomk.with_next(frame(ready, [(5, "a b c d e f g h")])).collect(), [(5, "a b c d e f g h")])) == 0
    assert max(check_next(bottomk.with_next(frame(ready, [(None, "a b"), (None, "c d")])).collect(), [(None, "a b"), (None, "c d")])) == 0


def test_sketches_merge(ready):
    rng = np.random.default_rng(1)
    parts = [" ".join(f"w{j}" for j in rng.integers(0, 4000, 900)) for _ in range(6)]
    found = bottomk.sketches(frame(ready, [(i % 2, t) for i, t in enumerate(parts)]))
    merged = {r.doc_id: np.array(r.sketch, np.uint64) for r in bottomk.merge(found, "doc_id").collect()}
    hasher = bottomk.Hasher()
    for i in (0, 1):
        whole = np.concatenate(hasher.shingles(parts[i::2]))
        assert merged[i].tolist() == bottomk.smallest(whole).tolist()
        true = len(set().union(*(shingles(t) for t in parts[i::2])))
        assert abs(bottomk.distinct(merged[i]) / true - 1) < 0.35
    small, large = (bottomk.smallest(h) for h in hasher.shingles([parts[0][:2000], parts[0]]))
    assert bottomk.containment(small, large) > 0.8 and bottomk.containment(large, small) < 0.6
    empty_rows = bottomk.merge(bottomk.sketches(frame(ready, [(1, ""), (1, None)])), "doc_id").collect()
    assert [(r.doc_id, r.sketch) for r in empty_rows] == [(1, [])]


# ---- 7: pages ----

def article(html):
    inside = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", html, re.S)[1]
    from html import unescape

    lines = (" ".join(unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def trees(ready):
    return dom_boosting.fit(ready.read.parquet(f"{FOLDER}/pages.parquet"))


def test_pages(ready, trees):
    pages = ready.read.parquet(f"{FOLDER}/pages.parquet")
    found = {r.page_id: r for r in dom_boosting.extract(pages, trees).collect()}
    for page in pages.collect():
        assert found[page.page_id].text == article(page.html) and found[page.page_id].n_chars == len(article(page.html))


def test_pages_of_another_make(ready, trees):
    held = ready.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id >= 100").limit(60).collect()
    wrong = 0
    for row in held:
        page = dom_boosting.Page(row.html)
        other = dom_boosting.Page(dom_boosting.disguised(page, dom_boosting.weak_labels(page), row.page_id))
        label = dom_boosting.weak_labels(other)
        other.attrs = [a.replace("x-article", "") for a in other.attrs]
        wrong += other.text(dom_boosting.decode(other.parent, trees.chance(other.features()))) != other.text(label)
    assert wrong <= 6


@pytest.mark.parametrize("seed", range(20))
def test_choice_over_the_tree_is_the_most_probable(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
    chance = rng.random(n)
    best = max((c for c in range(1 << n) if all(not c >> i & 1 or i == 0 or c >> parent[i] & 1 for i in range(n))),
               key=lambda c: sum(math.log(chance[i] if c >> i & 1 else 1 - chance[i]) for i in range(n)))
    assert dom_boosting.decode(parent, chance).tolist() == [bool(best >> i & 1) for i in range(n)]


def test_odd_pages(ready, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text"), (4, "u", "<p>unclosed <b>bold<p>next &lt;x&gt; &#233;&nbsp;&amp;"),
            (5, "u", "</div></p><<<>>> & < p"), (5, "u", "<div>" * 3000 + "deep"), (7, "u", "<script>var a='<p>x</p>'</script>")]
    pages = ready.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    found = dom_boosting.extract(pages, trees).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert {r.page_id: r.text for r in found}[1] == ""
    none = pages.limit(0)
    assert dom_boosting.fit(none) is None and dom_boosting.extract(none, None).collect() == []
    page = dom_boosting.Page(rows[3][2])
    assert page.text([True] * 9) == "unclosed bold\nnext <x> é &"


# ---- 8: SimHash ----

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def brute_components(values, distance=4):
    """Root (smallest index) of each value."""
    values = np.array(values, np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1:] ^ values[a]) <= distance) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_simhash(ready, documents):
    prints = [plain_fingerprint(d.text) for d in documents]
    roots = brute_components(prints)
    assert collections.Counter(map(tuple, rows_of("op8_simhash_grid", ready))) == collections.Counter(
        (d.doc_id, f"{p:016x}", documents[r].doc_id) for d, p, r in zip(documents, prints, roots))


def test_simhash_of_odd_rows(odd, empty):
    found = simhash_grid.near_duplicates(odd[0]).collect()
    prints = [plain_fingerprint(t) for _, t in odd[1]]
    roots = brute_components(prints)
    least = {}
    for (i, _), r in zip(odd[1], roots):
        least[r] = min(least.get(r, math.inf), math.inf if i is None else i)
    wanted = collections.Counter((i, p, None if least[r] == math.inf else least[r]) for (i, _), p, r in zip(odd[1], prints, roots))
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == wanted
    assert simhash_grid.near_duplicates(empty).collect() == []
    first = simhash_grid.first_of_each(odd[0])
    assert first.columns == odd[0].columns and first.count() == len(set(roots))
    assert simhash_grid.first_of_each(empty).collect() == []


@pytest.mark.parametrize("cell", [8192, 20])
def test_dense_groups_lose_no_link(ready, cell):
    rng = np.random.default_rng(3)
    values = set()
    for center in rng.integers(0, 1 << 63, 4).tolist():
        for _ in range(60):
            x = center
            for bit in rng.integers(0, 64, 6):
                x ^= 1 << int(bit)
            values.add(x)
    values |= set(rng.integers(0, 1 << 63, 200).tolist()) | {0, 1, 3, (1 << 64) - 1}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    points = ready.createDataFrame([(v,) for v in values], "fp long")
    found = simhash_grid.links(points, cell=cell).collect()
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 4 for a, b in found)
    got = dict(map(tuple, components(ready.createDataFrame(found, "a long, b long")).collect()))
    wanted = brute_components([v % (1 << 64) for v in values])
    assert [got.get(v, v) for v in values] == [values[r] for r in wanted]


def test_counts_bound_the_distance():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 1 << 63, (2, 500), np.uint64)
    y[:250] = x[:250] ^ (np.uint64(1) << rng.integers(0, 63, 250).astype(np.uint64))
    near = simhash_grid._manhattan(x, y)
    assert (near <= np.bitwise_count(x ^ y)).all()
    segments = [sum(abs(bin(int(a) >> s & 3).count("1") - bin(int(b) >> s & 3).count("1")) for s in range(0, 64, 2)) for a, b in zip(x, y)]
    assert near.tolist() == segments


def test_components(ready):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))] + [(i, i + 1) for i in range(500, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    wanted = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert dict(map(tuple, components(ready.createDataFrame(links, "a long, b long")).collect())) == wanted


# ---- 9: word pieces ----

def greedy(word, initial, continuing):
    at = count = 0
    while at < len(word):
        known = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count


def test_piece_counts(ready, documents, odd, empty):
    initial, continuing = map(set, wordpiece_lengths.vocabulary(RANKS))

    def expected(text):
        words = (text or "").encode().split()
        return len(words), sum(greedy(b" " + w, initial, continuing) for w in words)

    short = [(d.doc_id, d.text) for d in documents]
    rows = [(i, t) for i, t in odd[1] if not t or len(t) < 60_000 or t == LONG]
    assert collections.Counter(map(tuple, rows_of("op9_wordpiece_lengths", ready))) == collections.Counter((i, *expected(t)) for i, t in short)
    found = wordpiece_lengths.lengths(frame(ready, rows), RANKS).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter((i, *expected(t)) for i, t in rows)
    assert len(wordpiece_lengths.lengths(odd[0], RANKS).collect()) == len(odd[1])
    assert wordpiece_lengths.lengths(empty, RANKS).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_automaton_is_greedy(seed):
    rng = np.random.default_rng(seed)
    piece = lambda: bytes(rng.choice([97, 98], rng.integers(1, 5)).astype(np.uint8))
    initial, continuing = ({piece() for _ in range(4)} for _ in range(2))
    machine = wordpiece_lengths.Automaton(initial, continuing)
    for _ in range(60):
        word = bytes(rng.choice([97, 98], rng.integers(0, 10)).astype(np.uint8))
        assert machine.length(word) == greedy(word, initial, continuing)


def test_automaton_counts_as_the_library():
    from tokenizers.models import WordPiece

    vocabulary = ["[UNK]", "un", "a", "able", "##a", "##aff", "##able", "##ff", "##f", "##b", "##l", "##e", "a", "u", "##n"]
    library = WordPiece({w: i for i, w in enumerate(dict.fromkeys(vocabulary))}, unk_token="[UNK]")
    machine = wordpiece_lengths.Automaton([w.encode() for w in vocabulary[1:] if w[0] != "#"], [w[2:].encode() for w in vocabulary if w[0] == "#"])
    for word in ("unaffable", "unable", "aaaa", "able", "unx", "abffle", "u", "un"):
        assert machine.length(word.encode()) == len(library.tokenize(word))


# ---- 10: scores ----

def check_scores(rows, documents):
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in documents]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    seen = collections.Counter(w for i, words in tokens if not held(i) for w in words)
    total, kinds = sum(seen.values()), len(seen)
    wanted = collections.Counter((i, held(i), len(ws), sum(seen[w] > 0 for w in ws), total, round(sum(
        math.log10((seen[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 4)) for i, ws in tokens)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4) + 0.0)
                               for r in rows) == wanted
    assert all(r.score < 0 for r in rows)


def test_scores(ready):
    documents = [(d.doc_id, d.text) for d in ready.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = context_mixing.scores(ready.read.parquet("/root/testdata/sf0.01/documents.parquet"), block_tokens=50_000).collect()
    check_scores(rows, documents)
    known = [r for r in rows if not r.held_out]
    assert sum(r.score for r in known) > 1.03 * sum(r.base_score for r in known)
    # On what held-out texts share with the training texts the model is better; new words it must spell.
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)


def test_scores_of_odd_rows(ready, odd, empty):
    check_scores(context_mixing.scores(odd[0]).collect(), odd[1])
    assert context_mixing.scores(empty).collect() == []
    only_held = [(i, "a b") for i in range(200) if context_mixing.held_out(i)]
    check_scores(context_mixing.scores(frame(ready, only_held)).collect(), only_held)


def test_decisions_have_probability_one():
    """All symbols' paths together, and all next bytes, in any state of the mixer."""
    counts = [50, 3, 1, 1, 7, 20]
    tree = context_mixing.Tree(counts)
    rng = np.random.default_rng(0)
    tables = rng.integers(0, 50, (2, 2 << 14)).astype(np.float32)
    mixer = context_mixing.Mixer(1)
    for _ in range(20):
        mass = 0.0
        for symbol in range(len(counts)):
            _, node, bit = context_mixing._path(tree, np.array([symbol]))
            context = np.full(len(node), 5)
            trial = context_mixing.Mixer(1)
            trial.weights, trial.ones, trial.all = mixer.weights.copy(), mixer.ones.copy(), mixer.all.copy()
            x, gate = context_mixing._inputs(tree.chance[node], tables, (
                context_mixing._slots(node, context, 14, 0), context_mixing._slots(node, context, 14, 1)))
            mass += 10 ** trial.cost(np.zeros(len(node), np.int64), x, gate, bit).sum()
        assert abs(mass - 1) < 1e-9
        x, gate = context_mixing._inputs(rng.random(30) * 0.9 + 0.05, tables, (rng.integers(0, 1 << 14, 30), rng.integers(0, 1 << 14, 30)))
        mixer.cost(np.zeros(30, np.int64), x, gate, rng.integers(0, 2, 30))


# ---- near copies ----

def brute_near(rows, width=5):
    """Root (smallest index) of each text by exact Jaccard similarity of shingles, 0.8 or more."""
    words = [(t or "").encode().lower().split() for t in rows]
    sets = [{tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("small,part", [(8, 1 << 20), (2, 1 << 20), (2, 2000)])
def test_near_copies_against_brute_force(ready, small, part):
    rng = np.random.default_rng(4)
    rows = []
    for center in range(12):
        words = [f"w{rng.integers(5000)}" for _ in range(int(rng.integers(60, 300)))]
        rows.append(" ".join(words))
        for _ in range(30 if center < 2 else 5):  # copies with 1 to 14 places changed, some of them copied on
            changed = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(1, 15))):
                changed[at] = f"x{rng.integers(5000)}"
            rows.append(" ".join(changed))
            words = changed if rng.random() < 0.3 else words
    roots = brute_near(rows)
    assert 20 < len(set(roots)) < len(rows) - 20
    kept = near_copies.first_of_each(frame(ready, list(enumerate(rows))), small=small, part=part).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots))


def test_near_copies_drop_what_few_bits_miss(ready, documents):
    roots = brute_near([d.text for d in documents])
    kept = near_copies.first_of_each(ready.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(documents[i].doc_id for i in set(roots))
    bits = brute_components([plain_fingerprint(d.text) for d in documents])
    assert len(set(roots)) < len(set(bits))


def test_near_copies_of_odd_rows(odd, empty):
    first = near_copies.first_of_each(odd[0])
    assert first.columns == odd[0].columns and first.count() == len(set(brute_near([t for _, t in odd[1]])))
    assert near_copies.first_of_each(empty).collect() == []


# ---- pipeline ----

def test_pipeline(ready, documents):
    docs = ready.read.parquet(f"{FOLDER}/documents.parquet")
    verdicts = {r.doc_id: r.kept for r in rows_of("op4_divergence", ready)}
    kept = [d for d in documents if verdicts[d.doc_id]]
    lined = [(d.doc_id, t) for d, (t, _, _) in zip(kept, brute_lines([d.text for d in kept], winnowing.WORDS))]
    roots = brute_components([plain_fingerprint(t) for _, t in lined])
    firsts = [lined[i] for i in sorted(set(roots))]
    stages = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(ready, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = queries.materialize(docs, name)
        stages.append(sorted((r.doc_id, r.text) for r in docs.collect()))
        assert docs.where("n_chars <> char_length(text)").count() == 0
    assert stages == [[(d.doc_id, d.text) for d in kept], lined, firsts]
    coder = tokenizer("word_bpe_49k.json")
    check_packing(corpus_pipeline.run(ready, FOLDER).collect(), [(i, plain_ids(coder, t, 2)) for i, t in firsts])


def test_stages_of_odd_and_empty_tables(ready, odd, empty):
    for docs in (odd[0], empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(ready, docs, FOLDER).collect()


def test_registered():
    names = [n for n in registered.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in registered.queries() and set(queries.oracle_sql()) <= set(registered.oracle_sql())
