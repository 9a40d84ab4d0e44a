"""Corpus operators against brute force, the tokenizers library and exact round trips; edge cases of each."""
import hashlib
import itertools
import math
import random
import signal
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("tokenizers")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from caresignal.llm import (bpe_stream, crf_quality, embed_dedup, host_rules, hyperminhash, license_scan, packing,  # noqa: E402
                            perspective, queries, token_attribution, window_dedup)
from caresignal.llm.common import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = P.path("word_bpe_49k.json")
BYTE = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, __row int"
ODD = [None, "", " \n\t ", "one", "one two", "Ünïcode ÉÉ\x1cx　y z", "<|endoftext|> a<|startoftext|>b", "a\nb\nc\nd", "w " * 30_000, "x" * 20_000]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, one id with two texts, clashing extra columns."""
    rows = [(i, t, None, "s" if i % 2 else None, None, "clash", 1) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[8], (4, "another text of this id", "en", "s", 3, None, None), (None, "no id at all here", "en", "s", 3, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return pq.read_table(f"{SF}/documents.parquet").to_pydict()


def smallest_reachable(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    cases = [[(rng.randrange(300), rng.randrange(300)) for _ in range(160)], [(k, k + 1) for k in range(80)], [(5, 5)], []]
    for pairs in cases:
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
        nodes = {x for p in pairs for x in p if p[0] != p[1]}
        assert got == smallest_reachable(nodes, [p for p in pairs if p[0] != p[1]])


# -- 1

def brute_vectors(rows, t=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            ok[k] = a / np.linalg.norm(a)
    pairs = [(a, b) for a, b in itertools.combinations(ok, 2)
             if rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= t]
    comp = smallest_reachable(range(len(rows)), pairs)
    low = defaultdict(lambda: None)
    for k in ok:
        low[comp[k]] = min(rows[k][0], low[comp[k]] if low[comp[k]] is not None else rows[k][0])
    n = [sum(k in p for p in pairs) for k in range(len(rows))]
    return sorted(((i, n[k], low[comp[k]] if k in ok else i) for k, (i, _, _) in enumerate(rows)), key=str)


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8))
    rows = [(k, (centers[k % 12] + rng.normal(size=8) * 0.12).tolist(), int(k % 3)) for k in range(400)]
    rows += [(1000 + k, [3.0 * x for x in rows[0][1]], 0) for k in range(5)] + [(1010, rows[0][1], 0), (1010, rows[0][1], 0)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [1.0, None], 1), (2004, [float("nan")] * 8, 1),
             (2005, rows[0][1], None), (None, rows[0][1], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [1e30] * 8, 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int")
    want = brute_vectors(rows)
    for cell, block in ((4000, 1024), (20, 16)):  # one cell and block, then many with guests
        monkeypatch.setattr(embed_dedup, "CELL_ROWS", cell)
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        got = embed_dedup.link_vectors(df).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.link_vectors(df.limit(0)).collect() == []


# -- 2

def test_attribution(spark, odd_docs, no_docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = [x for x in texts()["text"][:60]] + [x for x in ODD if x and len(x) < 1000]
    for text in docs:
        spans = token_attribution.line_sections(text)
        got, total = token_attribution.attribute(text, spans, BYTE, "majority")
        raw = text.encode()
        enc, _ = token_attribution._encoding(BYTE)
        ids = enc.encode_ordinary(text)
        assert ids == t.encode(text, add_special_tokens=False).ids and total == len(ids)
        want, at = np.zeros(len(spans) + 1), 0
        owner = [k for k, (a, b) in enumerate(spans) for _ in text[a:b].encode()]
        for i in ids:
            n = len(enc.decode_single_token_bytes(i))
            own = owner[at:at + n]
            want[max(dict.fromkeys(own), key=own.count)] += 1
            at += n
        assert at == len(raw) and (got[:, 0] == want).all()
    text = "abc def ghi"
    got, total = token_attribution.attribute(text, [(0, 5), None, (3, 7), (9, 4), (8, 99)], BYTE, "split")
    assert got[:, 0].sum() == pytest.approx(total) and got[1].sum() == got[3].sum() == 0 and got[-1, 0] > 0
    df, rows = odd_docs
    out = token_attribution.attribute_tokens(df, BYTE, spans=token_attribution.line_sections, rule="start").collect()
    by = defaultdict(float)
    for r in out:
        by[(r["doc_id"], r["doc_tokens"])] += r["tokens"]
    for (i, n), v in by.items():
        assert v == n * len([1 for r in rows if r[0] == i and len(token_attribution.token_ends(r[1] or "", BYTE)) == n])
    assert token_attribution.attribute_tokens(no_docs, BYTE, spans=token_attribution.line_sections).collect() == []


def test_long_text_is_encoded_whole(monkeypatch):
    text = " ".join(texts()["text"][:40])
    want = token_attribution.token_ends(text, BYTE)
    monkeypatch.setattr(token_attribution, "_STRETCH", 500)
    assert (token_attribution.token_ends(text, BYTE) == want).all()


# -- 3

def check_packed(rows, want_ids, limits):
    tokens, segments, loss = limits
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= tokens and len(pieces) <= segments and sum(r["n_loss"] for r in pieces) <= loss
    for i, many in want_ids.items():
        left = [(k, len(ids)) for ids in many for k in [zlib.crc32(np.array(ids, "<u4").tobytes())]]
        assert sum(r["length"] for r in docs[i]) == sum(n for _, n in left)
        if len(many) == 1:
            at = 0
            for r in sorted(docs[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(many[0])
                assert r["ids_crc32"] == zlib.crc32(np.array(many[0][at:at + r["length"]], "<u4").tobytes())
                at += r["length"]
    return seqs


def test_packing_documents(spark, odd_docs, no_docs):
    t = Tokenizer.from_file(WORD)
    df, rows = odd_docs
    out = packing.pack_documents(df, WORD).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(t.encode(r[1] or "", add_special_tokens=False).ids + [1])
    check_packed(out, ids, (2048, 256, 2048))
    d = texts()
    out = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), WORD).collect()
    ids = {i: [t.encode(x, add_special_tokens=False).ids + [1]] for i, x in zip(d["doc_id"], d["text"])}
    seqs = check_packed(out, ids, (2048, 256, 2048))
    total = sum(len(v[0]) for v in ids.values())
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(r["length"] for r in s) for s in seqs.values()))
    assert pad <= 0.01 * total
    assert packing.pack_documents(no_docs, WORD).collect() == []


def test_packing_instruction_limits(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        n = rng.choice([0, 1, 5, 40, 200, 700])
        rows.append((k, [rng.randrange(1000) for _ in range(n)], [rng.random() < 0.6 for _ in range(n)]))
    rows += [(900, None, None), (901, [7, 8, 9], None), (902, [1] * 9, [True])]
    df = spark.createDataFrame(rows, "example_id bigint, ids array<int>, loss_mask array<boolean>").repartition(2, "example_id")
    out = packing.pack_examples(df, limits=(256, 6, 100)).collect()
    check_packed(out, {i: [x] for i, x, _ in rows if x}, (256, 6, 100))
    assert {r["doc_id"] for r in out} == {i for i, x, _ in rows if x}
    assert sum(r["n_loss"] for r in out) == sum(sum(m or []) for _, _, m in rows)


def test_packing_tiny_texts(spark):
    rows = [(i, (None, "", "one", " \n")[i % 4]) for i in range(2000)]

    def late(*_):
        raise TimeoutError("the packer does not end")
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    try:
        packer = packing.Packer(2048, 256, 2048)
        seqs = [s for i in range(2000) for s in packer.add(packing.Piece(i, 0, np.array([1], "<u4"), 1))] + list(packer.finish())
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert sorted(p.key for s in seqs for p in s) == list(range(2000)) and max(map(len, seqs)) == 256
    t = Tokenizer.from_file(WORD)
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), WORD).collect()
    seqs = check_packed(out, {i: [t.encode(x or "", add_special_tokens=False).ids + [1]] for i, x in rows}, (2048, 256, 2048))
    sizes = [sum(r["length"] for r in s) for s in seqs.values()]
    assert all(n & (n - 1) == 0 for n in sizes)


# -- 4

def library(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_streaming_bpe_equals_library():
    t, b = Tokenizer.from_file(WORD), bpe_stream.load(WORD)
    rng = random.Random(2)
    words = [w.replace("</w>", "") for w in t.get_vocab() if w.isascii()]
    cases = [x for x in ODD if x is not None] + texts()["text"][:80]
    cases += ["ΑΣ ΣΑΣ İstanbul", "é à́ ́a", "!!!'s ''re '''", "ab" * 3000 + "'re" + "é" * 3000, "'" * 5000 + "re", "x" * 4094 + "'re",
              "1234567890" * 900, "!?'" * 2000, "한국어 " * 9, "a\x85b\xa0c　d"]
    cases += ["".join(rng.choice(words) for _ in range(rng.randint(100, 2500))) for _ in range(40)]
    cases += ["".join(rng.choice(["e", "t", "th", "in", "er", "tion", "é", "'", "!", "1", "É", "Σ", "́"]) for _ in range(rng.randint(1, 9000))) for _ in range(40)]
    for c in cases:
        assert bpe_stream.digest(b, c) == library(t, c)
        assert list(b.encode(c, block=64)) == t.encode(c, add_special_tokens=False).ids


def test_lookahead_suffices_on_long_runs():
    """Whatever follows, tokens that end `lookahead` symbols before the window's end stay as they are."""
    b = bpe_stream.load(WORD)
    rng = random.Random(8)
    words = [w.replace("</w>", "") for w in b.vocab if w.isascii() and w.replace("</w>", "").isalpha()]
    for _ in range(30):
        run = "".join(rng.choice(words) for _ in range(400)).lower()
        assert list(b._run([run])) == b._pretoken(run)


def test_bpe_frame(spark, odd_docs, no_docs):
    t = Tokenizer.from_file(WORD)
    df, rows = odd_docs
    got = sorted(tuple(r) for r in bpe_stream.encode_digests(df.filter("doc_id IS NOT NULL"), WORD).collect())
    assert got == sorted((r[0], *library(t, r[1])) for r in rows if r[0] is not None)
    assert bpe_stream.encode_digests(no_docs, WORD).collect() == []
    some = bpe_stream.decode(bpe_stream.encode(df.filter("doc_id = 6"), WORD), WORD).first()["text"]
    assert some == t.decode(t.encode(ODD[6], add_special_tokens=False).ids, skip_special_tokens=False)


# -- 5

def brute_near(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    pairs = [(rows[a][0], rows[b][0]) for a, b in itertools.combinations(range(len(rows)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = smallest_reachable([i for i, _ in rows], pairs)
    return sorted((i, len(s), comp[i], comp[i] == i) for (i, _), s in zip(rows, sets))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rng = random.Random(block)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for size in (1, 2, 3, 5, 8, 13, 30, 60, 130, 400):
        for _ in range(6):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(5):
                rows.append(" ".join(edited(rng, base, rng.randrange(0, max(2, size // 20)))))
    base = [rng.choice(vocab) for _ in range(80)]  # a large group whose members differ more and more
    rows += [" ".join(edited(rng, base, rng.randrange(0, 6))) for _ in range(120)] + [" ".join(base).upper()] * 20
    rows += ["", None, " \n ", "A\x0bb", "a B", "same words " * 3000, "same words " * 3000]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, regs string")
    for k in (4, 5) if block == 256 else (4,):
        got = sorted(tuple(r) for r in hyperminhash.near_duplicates(df, shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == brute_near(rows, k)


def test_short_near_duplicates(spark):
    """Pairs with c common shingles and d others, words of their own; and one passage that many short texts share."""
    rng, rows, want = random.Random(11), [], []
    for k in range(6000):
        c = rng.randrange(4, 21) if k % 10 else rng.randrange(50, 90)
        d = rng.randrange(1, c // 4 + 2) if k % 3 else c // 4
        w, i = [f"p{k}w{j}" for j in range(c + d + 3)], rng.randrange(d + 1)
        pair = [(2 * k, " ".join(w[i:])), (2 * k + 1, " ".join(w[:len(w) - d + i]))]
        rows += pair
        want += brute_near(pair, 4)
    same = "a very common line of some ten words or so".split()
    many = [(20_000 + k, " ".join(same + [f"v{rng.randrange(40)}" for _ in range(rng.randrange(4))])) for k in range(400)]
    df = spark.createDataFrame(rows + many, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in hyperminhash.near_duplicates(df, shingle=4).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(want + brute_near(many, 4))


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    df, rows = odd_docs
    got = hyperminhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert {r["component_id"] for r in got if r["doc_id"] == 4} == {4}
    assert hyperminhash.near_duplicates(no_docs).collect() == []
    kept = hyperminhash.keep_one_per_group(df)
    assert kept.columns == df.columns


def test_register_estimate():
    rng = np.random.default_rng(4)
    for j in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
            n = int(1500 * 2 * j / (1 + j))
            a, b = np.unique(pool[:1500]), np.unique(np.concatenate([pool[:n], pool[1500:3000 - n]]))
            x, y = hyperminhash.registers(a), hyperminhash.registers(b)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(float(hyperminhash.estimate(x, y)) - true)
            assert float(hyperminhash.estimate_matrix(x[None], y[None])[0, 0]) == pytest.approx(float(hyperminhash.estimate(x, y)))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < hyperminhash.MARGIN


# -- 6

def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        s, t = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        z, marg = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s[i] * y for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            z += w
            marg += w * np.array(path)
        assert crf_quality.forward_backward(s.tolist(), np.exp(t).tolist()) == pytest.approx(marg / z)
        m, _ = crf_quality._batch_fb(s[None], np.array([n]), t)
        assert m[0, :, 1] == pytest.approx(marg / z)


def test_quality_is_learned_from_training_folds(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op6_crf_quality(spark, sf).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.95


def test_quality_sample_is_bounded_in_lines(spark):
    """The driver gets whole documents, in the order of the hash, up to the bound of lines; repeated rows count once."""
    rows = [(k, "\n".join(f"word {j} of {k}" for j in range(k % 9 + 1))) for k in range(80)]
    df = spark.createDataFrame(rows + [rows[0]] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, quality int")
    seen = []
    real = crf_quality.fit
    try:
        crf_quality.fit = lambda data, y: seen.append((data, y)) or real(data, y, iterations=2)
        for bound in (10**6, 60, 0):
            crf_quality.train(df, labels, max_total=bound)
    finally:
        crf_quality.fit = real
    (every, _), (some, y), (none, _) = seen
    assert len(every) == len([k for k in range(80) if zlib.crc32(str(k).encode()) % 4 != 2])
    assert sum(len(x) for x, _ in some) <= 60 < sum(len(x) for x, _ in some) + 9 and len(some) == len(y)
    assert none == []


def test_length_classes():
    """Classes cover all documents and padding at most doubles their lines."""
    lens = np.array(sorted([1, 1, 2, 3, 3, 7, 8, 15, 16, 16, 40, 900], reverse=True))
    got = crf_quality._length_classes(lens)
    assert [a for a, _ in got] == [0, *[b for _, b in got][:-1]] and got[-1][1] == len(lens)
    assert all(lens[a] < 2 * lens[b - 1] for a, b in got)
    rng = np.random.default_rng(1)
    data = [(rng.normal(size=(n, len(crf_quality.FEATURES))) + k % 2, np.ones(n)) for k, n in enumerate([*lens, *lens])]
    y = np.array([k % 2 for k in range(len(data))], float)
    split = crf_quality.fit(data, y, iterations=20)
    whole_classes, crf_quality._length_classes = crf_quality._length_classes, lambda lens: [(0, len(lens))]
    try:
        whole = crf_quality.fit(data, y, iterations=20)
    finally:
        crf_quality._length_classes = whole_classes
    assert np.allclose(split.weights, whole.weights) and np.allclose(split.trans, whole.trans)


def test_quality_odd(spark, odd_docs, no_docs):
    df, rows = odd_docs
    labels = spark.createDataFrame([(0, 1), (1, None)], "doc_id bigint, quality int")
    model = crf_quality.train(df, labels)
    assert not model.fitted
    got = crf_quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    rng = random.Random(1)
    data = [crf_quality.line_features(" ".join("ab" if k % 2 else rng.choice(["AB!!", "#$%"]) for _ in range(9))) for k in range(60)]
    model = crf_quality.fit(data, np.array([k % 2 for k in range(60)], float), iterations=30)
    for t in ODD:
        assert 0 <= model.score(t) <= 1
    assert crf_quality.keep_documents(df, model).columns == df.columns
    assert crf_quality.score(no_docs, model).collect() == []


# -- 7, 10: SQL compares the whole tables; here the odd cases

def brute_base(t):
    t = t or ""
    w = t.encode().split()
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {i + d for i, x in enumerate(g) for d in range(3) if g.count(x) > 1} if len(g) < 2000 else set(range(len(w)))
    lines = [x for x in t.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice))


def test_host_rules_odd(spark, odd_docs, no_docs):
    df, rows = odd_docs
    got = host_rules.host_quality(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], *(r[c] for c in host_rules.BASE)) for r in got), key=key) == sorted(((r[0], *brute_base(r[1])) for r in rows), key=key)
    rules = [("a b c " * 20, 1), ("x y z w " + "q" * 5 + " x y z", 0), ("a b c d a b c d a", 0), ("| # $\n\n| # $", 0)]
    for t, _ in rules:
        r = host_rules.base_counts(spark.createDataFrame([(t,)], "text string")).first()
        assert tuple(r[c] for c in host_rules.BASE) == brute_base(t)
    assert host_rules.host_quality(no_docs).collect() == []
    assert host_rules.keep_documents(df).columns == df.columns


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(k, good if k % 10 else bad, "fine") for k in range(100)] + [(200 + k, bad if k % 20 else good, "junk") for k in range(100)]
    rows += [(400, good, None), (401, bad, None), (402, good, "junk2"), (403, bad, "junk2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"] for r in host_rules.host_quality(df).filter("kept").collect()}
    assert kept == {k for k in range(100) if k % 10} | {400} | ({402} & kept)  # junk goes whole, a null host judges itself
    assert {r["doc_id"] for r in host_rules.keep_documents(df).collect()} == kept


def test_window_dedup_odd(spark, odd_docs, no_docs):
    df, rows = odd_docs
    out = window_dedup.remove_repeats(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"] and out.count() == len(rows)
    passage = "first line\nsecond line\n\nthird line\nfourth line"
    d = [(1, "intro\n" + passage + "\nend"), (2, passage), (2, passage), (3, "a\n first line \nsecond line\nthird line\nb"), (4, "x\ny\nx\ny\nx\ny"), (None, None)]
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in window_dedup.remove_repeats(spark.createDataFrame(d, "doc_id bigint, text string")).collect()}
    assert got == {(1, d[0][1], 0), (2, "", 4), (3, "a\nb", 3), (4, "x\ny", 4), (None, None, 0)}
    assert window_dedup.remove_repeats(no_docs).collect() == []


# -- 8

def test_perspectives(spark, monkeypatch):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 3, "cy", None), (1, 3, "cy", None), (1, 40, "ann", "late"),
            (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, " ", ""), (3, 1, None, "q")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    got = {(r["conv_id"], r["assistant"], r["part"]): r for r in perspective.rotate(df).collect()}
    assert set(got) == {(1, a, p) for a in ("ann", "bob", "cy") for p in (0, 1)} | {(None, "ann", 0), (3, "unknown", -1), (3, "unknown", 0)}
    r = got[(1, "ann", 0)]
    assert r["text"] == ("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\nyo<|end|>\n<|user name=cy|>\n<|end|>\n")
    assert [r["text"][m["start"]:m["end"]] for m in r["mask"]] == ["hi < |end|><|end|>\n"] and r["n_turns"] == 4
    assert got[(1, "bob", 1)]["n_own"] == 0
    monkeypatch.setattr(perspective, "PART_LIMIT", 4)
    many = spark.createDataFrame([(7, 0, "ann" if k % 2 else "bob", f"t{k}") for k in range(40)], "conv_id bigint, turn bigint, role string, text string")
    out = perspective.rotate(many).collect()
    assert len({r["sub"] for r in out}) > 1 and sum(r["n_turns"] for r in out) == 80 and sum(r["n_own"] for r in out) == 40
    assert perspective.rotate(many.limit(0)).collect() == []


def test_big_parts_stay_in_order(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, rng.choice([0, 1, 5, 31, 32]) if c != 2 else None, rng.choice(["ann", "bob", "system"]), f"t{rng.randrange(10**6)}" * rng.randrange(1, 3))
            for c in (1, 2, None) for _ in range(150)] + [(3, 0, "ann", "few"), (3, 1, "bob", "turns")]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)

    def joined():
        out = defaultdict(lambda: ["", [], 0])
        got = sorted(perspective.rotate(df).collect(), key=lambda r: (r["part"], r["sub"]))
        for r in got:
            x = out[r["conv_id"], r["assistant"], r["part"]]
            x[1] += [(m["start"] + len(x[0]), m["end"] + len(x[0])) for m in r["mask"]]
            x[0] += r["text"]
            x[2] += r["n_turns"]
        return dict(out), got
    for limit in (10, 64):
        monkeypatch.setattr(perspective, "PART_LIMIT", 10**6)
        whole, one = joined()
        monkeypatch.setattr(perspective, "PART_LIMIT", limit)
        cut, many = joined()
        assert {r["sub"] for r in one} == {0} and len(many) > len(one) and max(r["n_turns"] for r in many) == limit
        assert cut == whole


# -- 9

def test_licenses(spark, odd_docs, no_docs):
    d = texts()
    model = license_scan.fit([t.split("\n")[0] for t in d["text"]])
    assert license_scan.scan_text("the terms of the general public are in the work", model) == []
    assert license_scan.scan_text(None, model) == license_scan.scan_text("", model) == []
    for f, ts in license_scan.TEMPLATES.items():
        for t in ts:
            assert f in {h[1] for h in license_scan.scan_text("some words\n" + t + "\nmore", model)}, t
    noise = " ".join(d["text"][0].split()[:400])
    long = noise + " Licensed under the Apache License, Version 2.0. " + noise
    assert {h[1] for h in license_scan.scan_text(long.replace("\n", " "), model)} == {"Apache-2.0"}
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    lines = ("Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.")
    want = {i for i, x in zip(t["doc_id"], t["text"]) if any(y in x for y in lines)}
    assert {r["doc_id"] for r in queries.op9_license_scan(spark, sf).collect()} == want
    assert license_scan.scan(odd_docs[0], license_scan.train(odd_docs[0])).collect() == []
    assert license_scan.scan(no_docs, license_scan.train(no_docs)).collect() == []
