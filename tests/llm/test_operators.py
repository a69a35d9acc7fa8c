"""The ten corpus operators: brute force, round trips, and the defined results of odd input."""

import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from textloom.llm import chat, classifier, counting, epsilon_grid, mixing, packing, quality, simhash, substring, warc
from textloom.llm.common import buffers, prefix_sums, words
from textloom.llm.components import connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, passed string"
VOCAB = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "tes") for b in ("n", "k", "va", "rum") for c in ("a", "de", "is", "or", "ut")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def table(spark, rows):
    """(doc_id, text, source) rows, with columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", s, None, 1, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(random.Random(5), 30000)
    return table(spark, [(1, None, "a"), (2, "", "a"), (3, long, "a"), (3, long, "a"), (None, "some words here", "b"), (4, "short", None),
                         (5, "!!! ###", "b"), (6, " \n\t ", "b")])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# 1: token counts

def test_edits_equal_full_counts():
    tok, rng = counting.tokenizer(), random.Random(1)
    letters = list("ab  \n'sl12é.,\U0001F600 \t")
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        tree = counting.SegmentTree(tok, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 60]))
            put = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 8, 120])))
            tree.edit(a, b, put)
            text = text[:a] + put + text[b:]
            assert tree.text == text
            assert tree.total == sum(tree.tokens) == len(tok.encoding.encode_ordinary(text))
            assert (tree.ends[-1] if tree.ends else 0) == len(text)


def test_edit_encodes_only_its_surroundings():
    tree = counting.SegmentTree(counting.tokenizer(), prose(random.Random(2), 20000))
    tree.edit(50000, 50003, "xyz")
    assert 0 < tree.encoded < 1500


def test_token_counts_of_odd_rows(spark, odd, empty):
    got = sorted(counting.edit_counts(odd).collect(), key=str)
    n = {r.doc_id: r.n_tokens for r in got}
    assert len(got) == 8 and n[1] is None and n[2] == 0 and n[4] > 0
    assert counting.edit_counts(empty).count() == 0
    edits = spark.createDataFrame([(1, "one two three", [(4, 7, "TWO"), (13, 99, "!")]), (2, "same", None), (3, "gone", [(-5, 10, None)])],
                                  "doc_id long, text string, edits array<struct<start:int,end:int,put:string>>")
    after = {r.doc_id: r.n_tokens_after for r in counting.edit_counts(edits, "edits").collect()}
    count = counting.tokenizer().count
    assert after == {1: count("one TWO three!"), 2: count("same"), 3: 0}
    mixed = spark.createDataFrame([(1, "one two three", [(0, 3, "x"), (2, 7, "lost"), (None, 3, "y"), (8, None, "z"), None])], "doc_id long, text string, edits array<struct<start:int,end:int,put:string>>")
    r = counting.edit_counts(mixed, "edits").first()
    assert (r.n_edits, r.n_tokens_after) == (1, count("x two three"))


def test_edits_go_on_from_stored_leaves(spark):
    text = prose(random.Random(4), 5000)
    docs = spark.createDataFrame([(1, text, [(100, 103, "abc")]), (2, None, None), (3, "", None)], "doc_id long, text string, edits array<struct<start:int,end:int,put:string>>")
    first = counting.edit_counts(docs, "edits")
    again = docs.drop("text").join(first, "doc_id").selectExpr("doc_id", f"CASE doc_id WHEN 1 THEN '{text[:100] + 'abc' + text[103:]}' WHEN 3 THEN '' END AS text",
                                                               "array(named_struct('start', 20000, 'end', 20002, 'put', 'q')) AS edits", "leaf_chars", "leaf_tokens")
    got = {r.doc_id: r for r in counting.edit_counts(again, "edits", leaves=("leaf_chars", "leaf_tokens")).collect()}
    new = text[:100] + "abc" + text[103:]
    new = new[:20000] + "q" + new[20002:]
    assert got[1].n_tokens_after == counting.tokenizer().count(new) and got[2].n_tokens is None and got[3].n_tokens == 0


def test_token_counts_of_all_documents(spark, sf):
    rows = counting.op1_edit_token_counts(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = counting.tokenizer().encoding
    assert len(rows) == len(text)
    for r in rows:
        new = text[r.doc_id]
        for a, b, put in sorted(counting.redactions(new), reverse=True):
            new = new[:a] + put + new[b:]
        assert (r.n_tokens, r.n_tokens_after) == (len(enc.encode_ordinary(text[r.doc_id])), len(enc.encode_ordinary(new)))


# 2: mixing

def brute_mix(rows, weights, seed=mixing.SEED):
    """Copies of each (source, id) by one running sum in Python."""
    size, u = Counter(), mixing.draw(seed)
    rows = [r for r in rows if r[1]]
    for _, t, s in rows:
        size[s] += len(t)
    rest = (1 - sum(weights.values())) / max(1, sum(s not in weights for s in size))
    out, run = Counter(), defaultdict(int)
    for i, t, s in sorted(rows, key=lambda r: (r[2] or "", r[0] if r[0] is not None else -1)):
        x = weights.get(s, rest) * sum(size.values()) / size[s] * mixing.SCALE
        e = int(np.floor(x + 0.5))
        out[s, i] += (run[s] + e + u) // mixing.SCALE - (run[s] + u) // mixing.SCALE
        run[s] += e
    return +out


def test_mixing_equals_running_sum(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += rows[:20] + [(None, "no id here", "b")]
    w = {"b": 0.5, "c": 0.2}
    got = mixing.mix_sources(table(spark, rows), w).collect()
    assert Counter((r.source, r.doc_id) for r in got) == brute_mix(rows, w)
    chars = Counter()
    for r in got:
        chars[r.source] += len(r.text)
    assert abs(chars["b"] / sum(chars.values()) - 0.5) < 0.05
    assert "rank" in got[0].asDict() and "copy" in got[0].asDict()
    assert mixing.mix_sources(empty, w).count() == 0
    assert {r.doc_id for r in mixing.mix_sources(odd, {}).collect()} <= {3, None, 4, 5, 6}


def test_prefix_sums_spread_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("h" if rng.random() < 0.8 else None, rng.randint(0, 9), rng.randint(1, 5)) for _ in range(500)]
    got = prefix_sums(spark.createDataFrame(rows, "k string, o int, v long"), "k", ["o"], "v", parts=7).collect()
    for key in ("h", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert [r.o for r in mine] == sorted(r.o for r in mine)
        assert [r.before for r in mine] == list(np.cumsum([0] + [r.v for r in mine])[:-1])


# 3: packing

def test_nnls_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(20):
        a, b = rng.random((8, 20)), rng.random(8) * 5
        x = packing.nnls(a, b)
        grad = a.T @ (a @ x - b)
        assert (x >= 0).all() and (grad > -1e-6).all() and abs(grad @ x) < 1e-5


def test_packing_places_every_token_once(spark, odd, empty):
    rng = random.Random(7)
    rows = [(i, rng.choice([rng.randint(1, 300), rng.randint(1, 2048), rng.randint(2000, 9000)])) for i in range(700)]
    rows += rows[:5] + [(None, 77), (1000, None), (1001, 0), (1002, 2048), (1003, 4096)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    need = Counter((i, p * 2048, min(2048, n - p * 2048)) for i, n in rows for p in range(-(-(n or 0) // 2048)))
    assert Counter((r.doc_id, r.start, r.n_tokens) for r in got) == need
    packs = defaultdict(list)
    for r in got:
        packs[r.pack_id].append(r)
    assert max(sum(r.n_tokens for r in p) for p in packs.values()) <= 2048
    assert all(sorted(r.slot for r in p) == list(range(len(p))) for p in packs.values())
    assert sorted(packs) == list(range(len(packs)))
    assert sum(r.n_tokens for r in got) / len(packs) / 2048 > 0.93
    assert packing.pack_documents(empty).count() == 0
    assert {r.doc_id for r in packing.pack_documents(odd).collect()} == {3, None, 4, 5, 6}


# 4: chat

def brute_chat(rows):
    out, convs = [], defaultdict(set)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].add((t, role, text or ""))
    for c, turns in convs.items():
        state = chat.MACHINE.start
        order = sorted(turns, key=lambda x: tuple((v is not None, v) for v in x))
        for _, role, _ in order:
            state = chat.MACHINE.step.get((state, role), "")
        if state in chat.MACHINE.accept:
            parts = [(None, p, l) for p, l in chat.TEMPLATE.before]
            parts += [(role, text if p is chat.TEXT else p, l) for _, role, text in order for p, l in chat.TEMPLATE.turn[role]]
            parts += [(None, p, l) for p, l in chat.TEMPLATE.after]
            out += [(c, k, *x) for k, x in enumerate(x for x in parts if x[1])]
    return sorted(out, key=str)


def test_chat_equals_machine_in_python(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool"][: rng.choice([3, 7])]), rng.choice(["hi", "", None, "x" * 5000]))
            for c in range(150) for t in range(rng.randint(1, 4))]
    rows += [(500, 0, "user", "a"), (500, 0, "user", "a"), (500, 1, "assistant", "b"), (None, 0, "user", "z"), (501, 0, "system", "s"),
             (501, 1, "user", "<|end|>"), (501, 2, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, r.segment, r.role, r.text, r.loss) for r in chat.format_chat(df).collect()), key=str)
    assert got == brute_chat(rows) and any(r[0] == 500 for r in got)
    assert chat.format_chat(df.limit(0)).count() == 0


# 5: simhash

def brute_groups(docs):
    rows = [(i, t) for i, t in docs if i is not None and t]
    offsets, raw = buffers(pa.array([t for _, t in rows]))
    bits = simhash.fingerprints(raw, offsets)[:, : simhash.VERIFY_BITS]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        near = np.flatnonzero((bits[a] != bits[:a]).sum(1) <= simhash.MAX_DISTANCE)
        for b in near:
            x, y = root(rows[a][0]), root(rows[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent if root(i) != i}


def test_simhash_groups_equal_brute_force(spark, odd, empty):
    rng = random.Random(9)
    base = [prose(rng, rng.randint(40, 400)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(base)]
    for k in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, len(w) // 30])):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        docs.append((100 + k, " ".join(w)))
    got = {r.id: r.keep for r in simhash.groups(table(spark, [(i, t, "s") for i, t in docs])).collect()}
    want = brute_groups(docs)
    assert len(set(got.items()) & set(want.items())) >= 0.97 * len(want) and set(got) <= set(want)
    kept = simhash.keep_one(odd)
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, 3: 1, None: 1, 4: 1, 5: 1, 6: 1}
    assert kept.columns == odd.columns
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def drifted(seed, n, share):
    """(id, text) of n copies of one text, each with its own changes, ids shuffled."""
    rng = random.Random(seed)
    base = [f"word{rng.randrange(10**6)}x" for _ in range(300)]
    texts = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(len(w)), int(share * len(w))):
            w[k] = f"other{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    return list(enumerate(texts))


def test_simhash_shuffles_texts_once(spark):
    rng = random.Random(34)
    texts = [prose(rng, 80) for _ in range(6)]
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0]), (9, texts[1]), (None, texts[2]), (3, None), (4, ""), (4, "")]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.keep_one(table(spark, [(i, t, "s") for i, t in rows]))
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        parts = [p for p in plan.split("\n\n") if ") Exchange" in p and "text#" in p]
        assert len(parts) == 1
        want = [*enumerate(texts), (None, texts[2]), (3, None), (4, ""), (4, "")]
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_simhash_compares_linked_documents_further(spark):
    docs = drifted(21, 400, 0.10) + [(1000, drifted(21, 1, 0)[0][1])]  # the original has the largest id
    offsets, raw = buffers(pa.array([t for _, t in docs]))
    bits = simhash.fingerprints(raw, offsets)
    keys, near = simhash.block_values(bits), bits[:, : simhash.VERIFY_BITS]
    far = (near[:, None] != near[None]).sum(2)
    edges = [(docs[a][0], docs[b][0]) for a in range(len(docs)) for b in range(a)
             if far[a, b] <= simhash.MAX_DISTANCE and (keys[a] == keys[b]).any()]
    want = {(r.id, r.keep) for r in connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(want) > 300
    assert {(r.id, r.keep) for r in simhash.groups(table(spark, [(i, t, "s") for i, t in docs])).collect()} == want


def test_simhash_blocks_hold_at_the_threshold():
    rng = np.random.default_rng(22)
    n = simhash.BLOCKS * simhash.BLOCK_BITS
    a = rng.random((2000, n)) < 0.5
    b = a ^ (rng.random((2000, n)) < simhash.MAX_DISTANCE / simhash.VERIFY_BITS)
    for x, y in zip(a, b):  # exactly MAX_DISTANCE of the verified bits differ
        y[: simhash.VERIFY_BITS] = x[: simhash.VERIFY_BITS]
        y[rng.choice(simhash.VERIFY_BITS, simhash.MAX_DISTANCE, replace=False)] ^= True
    assert (simhash.block_values(a) == simhash.block_values(b)).any(1).mean() >= 0.9


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    got = {r.id: r.keep for r in connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent if root(x) != x}


# 6: substrings

def brute_windows(v, width):
    out = set()

    def build(l, r):
        if r - l + 1 >= width:
            c = l + int(np.argmin(v[l : r + 1]))
            out.add((c, l, r))
            build(l, c - 1)
            build(c + 1, r)

    zeros = [-1, *np.flatnonzero(v == 0), len(v)]
    for a, b in zip(zeros, zeros[1:]):
        build(a + 1, b - 1)
    return out


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(11)
    for _ in range(200):
        v = rng.integers(1, 2**60, rng.integers(1, 150)).astype(np.uint64)
        v[rng.random(len(v)) < 0.03] = 0
        width = int(rng.integers(2, 12))
        assert set(zip(*(x.tolist() for x in substring.compact_windows(v, width)))) == brute_windows(v, width)
    same = np.full(500, 7, np.uint64)
    assert [x.tolist() for x in substring.compact_windows(same, 43)] == [[0], [0], [499]]


def test_repeats_cover_what_brute_force_finds(spark, odd, empty):
    rng = random.Random(12)
    shared = [prose(rng, rng.randint(55, 160)) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = [prose(rng, rng.randint(5, 300))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts += [rng.choice(shared), prose(rng, rng.randint(5, 80))]
        docs.append((i, ". ".join(parts).replace(" ra", "\nRá", 3)))
    seen, must = {}, defaultdict(set)
    for i, t in docs:
        w = words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[3].tolist()
        own = []
        for k in range(len(w) - substring.MIN_WORDS + 1):
            g = tuple(w[k : k + substring.MIN_WORDS])
            own.append(g)
            if g in seen:
                must[i] |= set(range(k, k + substring.MIN_WORDS))
        seen.update(dict.fromkeys(own, i))
    got, text = defaultdict(set), dict(docs)
    for r in substring.repeats(table(spark, [(i, t, "s") for i, t in docs])).collect():
        assert r.first_doc_id < r.doc_id and r.n_words >= substring.MIN_WORDS
        starts = words(np.frombuffer(text[r.doc_id].encode(), np.uint8), np.array([0, len(text[r.doc_id].encode())]))[0]
        at = [len(text[r.doc_id].encode()[:s].decode()) for s in starts]
        got[r.doc_id] |= {k for k, c in enumerate(at) if r.start <= c < r.end}
    assert sum(len(must[i] & got[i]) for i in must) >= 0.98 * sum(map(len, must.values()))
    assert set(got) == set(must)
    cut = substring.cut_repeats(table(spark, [(i, t, "s") for i, t in docs]))
    left = {r.doc_id: r.text for r in cut.collect()}
    assert all(left[i] == text[i] for i in text if i not in got)
    assert all(sum(p in (left.get(i) or "") for i in left) <= 1 for p in shared if "\n" not in p)
    assert cut.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert substring.repeats(empty).count() == 0 and substring.repeats(odd).count() == 0
    assert Counter((r.doc_id, r.text) for r in substring.cut_repeats(odd).collect()) == Counter((r.doc_id, r.text) for r in odd.collect())


def test_repeats_around_a_widespread_sentence(spark):
    rng = random.Random(31)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs, want = [], set()
    for k in range(24):
        sentence = fresh((20, 30, 40)[k % 3])
        passage, n = f"{fresh(7)} {sentence} {fresh(48 - len(sentence.split()))}", (4, 20)[k % 2]
        around = [f"{fresh(80)} {x} {fresh(80)}" for x in [*[sentence] * n, passage, *[sentence] * n, passage]]
        want.add((len(docs) + 2 * n + 1, len(docs) + n))
        docs += around
    got = {(r.doc_id, r.first_doc_id) for r in substring.repeats(table(spark, [(i, t, "s") for i, t in enumerate(docs)])).collect()}
    assert got == want


def test_repeats_find_edited_passages(spark):
    rng = random.Random(32)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], {k: set() for k in range(4)}
    hashes = lambda t: words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[3]
    for k in range(240):
        p, edit = fresh((50, 60)[k // 4 % 2]), k % 4
        q = list(p)
        if edit == 3:
            q[20:20] = fresh(1)  # a word put in
        else:
            for x in rng.sample(range(len(q)), edit + 1):
                q[x] = fresh(1)[0]
        docs += [" ".join(fresh(40) + x + fresh(40)) for x in (p, q)]
        a, b = hashes(docs[-2]), hashes(docs[-1])
        if substring.passages(a, b, [(d, 0, len(b)) for d in range(-len(b), len(a))]):
            want[edit].add((len(docs) - 1, len(docs) - 2))
    got = {(r.doc_id, r.first_doc_id) for r in substring.repeats(table(spark, [(i, t, "s") for i, t in enumerate(docs)])).collect()}
    for edit, pairs in want.items():
        assert len(pairs) >= 10 and len(got & pairs) >= 0.9 * len(pairs), (edit, len(got & pairs), len(pairs))


def test_repeats_of_texts_that_repeat_a_line(spark):
    rng = random.Random(34)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], {}
    for k in range(24):  # the earlier text has the passage's line before, near or far from it, so it has two windows of one signature
        line = fresh(46)
        p = fresh(2) + line + fresh(2)
        docs += [fresh(20) + line + fresh((10, 300)[k % 2]) + p + fresh(20), fresh(30) + p + fresh(30)]
        want[len(docs) - 1] = 50
    for one, n, m in ((20, 60, 60), (1, 2000, 2000), (20, 60, 10), (60, 10, 10), (20, 60, 1000)):  # longer than verification sees at once
        line = fresh(one)
        docs += [fresh(60) + line * m + fresh(60), fresh(70) + line * n + fresh(50)]
        want[len(docs) - 1] = one * n
    got = Counter()
    for r in substring.repeats(table(spark, [(i, " ".join(t), "s") for i, t in enumerate(docs)])).collect():
        assert r.first_doc_id == r.doc_id - 1
        got[r.doc_id] += r.n_words
    assert got == want


def test_repeats_in_large_groups_lose_no_edited_passage(spark):
    rng = random.Random(33)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs, want = [], set()
    for _ in range(20):
        s, b = fresh(42), fresh(8)  # more than FEW texts have s, with other words around
        around = [s] * (substring.FEW + 4) + [s + fresh(1) + b] + [s] * 4 + [s + fresh(1) + b]
        docs += [fresh(60) + x + fresh(60) for x in around]
        want.add((len(docs) - 1, len(docs) - 6))
    got = {(r.doc_id, r.first_doc_id) for r in substring.repeats(table(spark, [(i, " ".join(t), "s") for i, t in enumerate(docs)])).collect()}
    assert got == want


def test_pairs_are_compared_many_at_once(monkeypatch):
    rng = np.random.default_rng(35)
    rows, calls, runs = [], [], substring._runs
    for k in range(300):
        b = rng.integers(0, 1 << 32, 120).astype(np.uint32)
        a = np.concatenate([b[20:100], b[:7]])
        rows.append({"a": k, "b": 1000 + k, "spots": [{"diag": -20, "lo": 60, "hi": 60}], "ta": a.tobytes(), "a0": 0, "tb": b.tobytes(), "b0": 0})
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("spots", substring._SPOT), ("ta", pa.binary()), ("a0", pa.int32()), ("tb", pa.binary()), ("b0", pa.int32())])
    monkeypatch.setattr(substring, "_runs", lambda *x: calls.append(1) or runs(*x))
    got = [r for x in substring._verify(iter([pa.RecordBatch.from_pylist(rows, kinds)])) for r in x.to_pylist()]
    assert got == [{"b": 1000 + k, "s": 20, "e": 100, "a": k, "x": 0, "y": 80} for k in range(300)]
    assert len(calls) <= 30


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_groups_of_windows_in_memory_and_in_files(monkeypatch, most):
    rng = np.random.default_rng(36)
    key, id_, p = rng.integers(-300, 300, 900), rng.integers(0, 50, 900), rng.integers(0, 1 << 16, 900)
    salt = np.where(key == 7, 1 + id_ % 3, 0).astype(np.int16)
    key[:90] = np.arange(1000, 1090)  # alone
    monkeypatch.setattr(substring, "AT_MOST", most)
    want, size = set(), lambda rows: sum(substring.FEW + 1 if x >> 12 & 1 else 1 for _, x in rows)
    groups = defaultdict(list)
    for k, s, i, x in zip(key.tolist(), salt.tolist(), id_.tolist(), p.tolist()):
        groups[k, s].append((i, x))
    for (k, s), rows in groups.items():
        want |= {(k, s, i, x, size(rows), *min(rows)) for i, x in rows if s or size(rows) > size([(i, x)])}
    batches = [pa.RecordBatch.from_arrays([pa.array(c[m : m + 100]) for c in (key, id_, p, salt)], ["key", "id", "p", "salt"]) for m in range(0, 900, 100)]
    packed = list(substring._packed(iter(batches), 5, True))
    got = []
    for part in range(5):
        own = [x.filter(pa.compute.equal(x.column(0), part)) for x in packed]
        got += [tuple(r.values()) for x in substring._grouped(iter([x for x in own if x.num_rows]), True) for r in x.to_pylist()]
    assert set(got) == want


# 7: quality

def test_quality_rules_on_odd_rows(spark, odd, empty):
    m = {(r.doc_id, r.text): r for r in quality.measure(odd).collect()}
    assert not m[1, None].passed and not m[2, ""].passed and not m[6, " \n\t "].passed
    assert m[4, "short"].passed and m[1, None].n_words == 0 and m[4, "short"]["rank"] == 1
    assert quality.keep(odd).columns == odd.columns
    assert quality.keep(empty).count() == 0
    junk = table(spark, [(1, " ".join(["In."] * 60), "s"), (2, "###$$$ %%%&&& " * 20, "s"), (3, "WHAT IS THIS OF THE AND!! " * 9, "s"),
                         (4, "the same line of text\n" * 20, "s"), (5, "The words of a clean text are in order and it is as it was. " + prose(random.Random(1), 30), "s")])
    assert [r.doc_id for r in quality.keep(junk).collect()] == [5]


def test_quality_has_no_longest_text(spark):
    long = "\n".join(f"The words of a clean text are in order and it is as it was. {i}" for i in range(75_000))
    assert [r.doc_id for r in quality.keep(table(spark, [(7, long, "s")])).select("doc_id").collect()] == [7]


def test_quality_keeps_good_labelled_documents(spark, sf):
    kept = {r.doc_id for r in quality.op7_quality_rules(spark, sf).select("doc_id").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert len(good - kept) <= 0.01 * len(good)


# 8: WARC

def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd_pages = spark.createDataFrame([(900, None, None), (901, "http://x\r\ny", ""), (None, "u", "é" * 700000), (902, "u", "same"), (902, "u", "same")],
                                      "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(odd_pages)
    index = warc.write_bundles(both, f"file://{tmp_path}", frame_bytes=20000, bundle_bytes=50000)
    assert index.count() == both.count()
    clean = lambda r: (r.page_id, None if r.url is None else r.url.replace("\r", "").replace("\n", ""), r.html)
    assert Counter(map(clean, warc.fetch(index, f"file://{tmp_path}").collect())) == Counter(map(clean, both.collect()))
    import io

    import zstandard

    frames = defaultdict(set)
    for r in index.collect():
        frames[r.bundle].add((r.frame_offset, r.frame_bytes))
    for name, own in frames.items():
        data = (tmp_path / name).read_bytes()
        assert sorted(own) == warc.read_seek_table(data)
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as f:
            whole = f.read()
        sizes = struct.unpack(f"<{2 * len(own)}I", data[-9 - 8 * len(own) : -9])[1::2]
        assert len(whole) == sum(sizes) and whole.startswith(b"WARC/1.1")
        while whole:  # record by record, as the format says
            fields, body = warc.parse(whole)
            head = whole.index(b"\r\n\r\n") + 4
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields) and fields["WARC-Type"] == "resource"
            assert whole[head + len(body) : head + len(body) + 4] == b"\r\n\r\n"
            whole = whole[head + len(body) + 4 :]
    assert warc.write_bundles(both.limit(0), f"file://{tmp_path}/none").count() == 0


# 9: embeddings

@pytest.mark.parametrize("block", [64, 4096])
def test_epsilon_grid_equals_brute_force(spark, block):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(900, 16)) * np.geomspace(1, 0.1, 16)
    x[600:] = x[rng.integers(0, 600, 300)] + rng.normal(size=(300, 16)) * rng.choice([0, 0.05, 0.2], (300, 1))
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5, x[5].tolist(), 1), (2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, 2.0], 1), (2003, [float("nan")] * 16, 1), (None, x[1].tolist(), 1), (2004, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.tril(u @ u.T >= 0.95, -1)
    want = {i: int(np.flatnonzero(near[i])[0]) for i in range(900) if near[i].any()}
    assert {r.id: r.first_id for r in epsilon_grid.near_duplicates(df, block=block).collect()} == want
    if block == 64:
        assert epsilon_grid.near_duplicates(df.limit(0)).count() == 0


# 10: classifier

def test_classifier_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, y = classifier.labelled(docs, labels)
    k = len(texts) * 3 // 4
    model = classifier.train(texts[:k], y[:k])
    offsets, raw = buffers(pa.array(texts[k:]))
    p = classifier.scores(model, raw, offsets)
    assert ((p[:, 0] >= 0.5) == (y[k:, 0] == 1)).mean() >= 0.95
    assert ((p[:, 1] >= 0.5) == (y[k:, 1] == 1)).mean() >= 0.85


def test_classifier_on_odd_rows(spark, odd, empty):
    good = [prose(random.Random(i), 40) for i in range(60)]
    bad = [t.replace(" ", "### ") for t in good]
    model = classifier.train(good + bad, np.array([[1, 0]] * 60 + [[0, -1]] * 60))
    got = [(r.doc_id, r.quality) for r in classifier.classify(odd, model).collect()]
    assert len(got) == 8 and {i for i, q in got if q is None} == {1, 2, 6}
    assert classifier.classify(empty, model).count() == 0
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(classifier.labelled(odd.dropDuplicates(["doc_id"]), labels)[1].tolist()) == [[-1, 0], [1, -1]]
