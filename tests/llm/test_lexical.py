"""Operators 11 to 13: the tiktoken library, brute force in plain Python, exact round trips, edge cases."""
import collections
import hashlib
import math
import random
import re
import unicodedata

import pyarrow.parquet as pq
import pytest

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from caresignal.llm import byte_transducer, norm_search, phrase_mining, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTE = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n string, rank string, word string"
ODD = [None, "", " \n\t ", "one", "One two. ONE two", "Ünïcode ÉÉ\x1cx　y z", "<|endoftext|> it's 12345", "a\nb\nc\nd", "w " * 30_000,
       "x" * 20_000, "é" * 5_000 + "中文" * 3_000, "a b, a b; a b! a b a b\x0ba b"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, None if i % 3 else "en", "s", "clash", "clash", None) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], rows[11], (4, "another text of this id", "und", "s", None, None, None), (None, "no id, one two here", "en", "s", None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return pq.read_table(f"{SF}/documents.parquet").to_pydict()


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


# -- 11

@pytest.fixture(scope="module")
def library():
    ranks = byte_transducer.load(BYTE).merges.ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(bpe, text, **how):
    return [int(x) for stretch in bpe.encode(text, **how) for x in stretch]


def test_transducer_equals_the_library(library):
    rng, bpe = random.Random(5), byte_transducer.ByteBpe(BYTE)
    alphabets = ["ab", "abc ", "0123 ", "etaoin shrdlu", "éü中文x ", "!?.#$ ", " \t\n\r\x0b\x1c\x85\xa0a", "'sltrev dm", "".join(map(chr, range(1, 128)))]
    for _ in range(1500):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 4, 30, 300])))
        want = library.encode_ordinary(text)
        assert ids_of(bpe, text) == want and ids_of(bpe, text, block=7) == want
        assert "".join(bpe.decode(bpe.encode(text))) == text
    for text in ["".join(rng.choices("abcdefghij", k=30_000)), "x" * 50_000, "中" * 9_000, " " * 5_000 + "x"]:
        assert ids_of(bpe, text) == library.encode_ordinary(text)
    assert bpe.machine.longest_wait < 2 * max(map(len, bpe.merges.ranks))  # tokens leave after a bounded wait


def test_splitting_of_every_character(library):
    bpe = byte_transducer.load(BYTE)
    for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x3400)]):
        s = f"a{c}a1{c}1 {c}!{c}"
        assert ids_of(bpe, s) == library.encode_ordinary(s), hex(ord(c))


def test_forgotten_states_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_transducer, "CACHE", 20)
    bpe = byte_transducer.ByteBpe(BYTE)
    bpe.machine = byte_transducer.Transducer(bpe.merges, max_states=50)
    for text in texts()["text"][:40]:
        assert ids_of(bpe, text) == library.encode_ordinary(text or "")
        assert len(bpe.machine._members) <= 50 and len(bpe._new) <= 20


def test_pairs_that_hold(library):
    """A pair holds exactly when the library leaves it as it is."""
    rng, merges = random.Random(2), byte_transducer.load(BYTE).merges
    for _ in range(4000):
        a, b = rng.choice(list(merges.raw) if rng.random() < 0.02 else range(2000)), rng.randrange(4000)
        raw = merges.raw[a] + merges.raw[b]
        assert merges.holds(a, b) == (raw not in merges.ranks and library._encode_single_piece(raw) == [a, b])


def test_digests(spark, library, odd_docs, no_docs):
    df, rows = odd_docs
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))))
    got = [tuple(r) for r in byte_transducer.encode_digests(df, BYTE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert byte_transducer.encode_digests(no_docs, BYTE).collect() == []
    back = byte_transducer.decode(byte_transducer.encode(df, BYTE), BYTE).collect()
    assert sorted(((r[0], r[1]) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    odd = spark.createDataFrame([(1, [None, 10 ** 6, -3, 72]), (2, None)], "doc_id int, ids array<int>")
    assert [r["text"] for r in byte_transducer.decode(odd, BYTE).orderBy("doc_id").collect()] == [library.decode([72]), ""]


def test_op11_query(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_byte_transducer(spark, SF).collect()}
    d = texts()
    for i, t in zip(d["doc_id"], d["text"], strict=True):
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert len(got) == len(d["doc_id"])


# -- 12

def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def brute_phrases(rows, least=10, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i:i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    cands = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    longer = collections.Counter()
    for (lang, p), v in cands.items():
        for q in (p[:2], p[1:]) if len(p) == 3 else ():
            longer[lang, q] = max(longer[lang, q], v)
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if len(p) == 2 and 100 * longer[lang, p] >= 50 * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, k, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for k, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("bounds", [{}, {"MAX_WORDS": 3}, {"MAX_WORD_BYTES": 3}, {"STRETCH": 200}])
def test_phrases_equal_brute_force(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(phrase_mining, k, v)
    rng = random.Random(7)
    words = ["the", "of", "a", "É", "x1", "zz\x1c", "q-r", "ÄB"]
    rows = []
    for k in range(120):
        text = "".join(rng.choices(words, weights=[9, 7, 5, 2, 2, 1, 1, 1])[0].title() + rng.choice([" ", " ", " ", "\t", ", ", "\n", "!", "\x0c"]) for _ in range(rng.randrange(60)))
        rows.append((k % 50, text, rng.choice(["en", "de", None, "und"]), None, "x", "y", "z"))
    rows += [(1, "new york city. " * 15 + "new york! " * 40, "en", None, None, None, None)] * 2 + [(2, None, "fr", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    for least, top in ((10, 2000), (3, 5)):
        got = sorted(tuple(r) for r in phrase_mining.mine_phrases(df, least, top).collect())
        assert got == brute_phrases([(r[2], r[1]) for r in rows], least, top) and got


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_017, 3_000_000_000_019, 7_000_000_000_001
    row = spark.range(1).select(phrase_mining._floor_score(*[phrase_mining.F.lit(x) for x in (a, left, right)]).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_phrases_of_odd_and_no_documents(spark, odd_docs, no_docs):
    df, rows = odd_docs
    assert sorted(tuple(r) for r in phrase_mining.mine_phrases(df, 2).collect()) == brute_phrases([(r[2], r[1]) for r in rows], 2)
    assert phrase_mining.mine_phrases(no_docs).collect() == []


def test_op12_query(spark):
    d = texts()
    assert sorted(tuple(r) for r in queries.op12_phrase_mining(spark, SF).collect()) == brute_phrases(list(zip(d["lang"], d["text"], strict=True)))


# -- 13

def brute_search(docs, items, top=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    parsed = [(i, collections.Counter(terms(t))) for i, t in docs]
    parsed = [(i, c, sum(c.values())) for i, c in parsed if c]
    n_docs, total = len(parsed), sum(n for *_, n in parsed)
    df = collections.Counter(t for _, c, _ in parsed for t in c)
    out = []
    for item, text in items:
        ts = set(terms(text))
        scored = []
        for i, c, n in parsed:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"GROUP": 16, "BUCKET": 4}, {"BLOCK_ITEMS": 2, "BUCKET": 8}, {"FOCUS": 0.01, "BUCKET": 16}, {"BLOCK_CHARS": 60}])
def test_search_equals_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(norm_search, k, v)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ÄB", "x9", "the", "of"]
    weights = [1] * 60 + [2, 2, 2, 40, 30]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n)).title()
    docs = [(k, text(rng.choice([1, 5, 40, 200])), "en", None, None, None, None) for k in range(300)]
    docs += [(1000 + k, docs[k % 3][1], None, None, None, None, None) for k in range(40)] + [docs[5]] * 12 + [(None, docs[7][1], None, None, None, None, None)] * 2
    docs += [(2000, None, None, None, None, None, None), (2001, "-- . !", None, None, None, None, None)]
    items = [(k, text(rng.choice([1, 8, 30]))) for k in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (None, "the w1"), (5, "w1 w2"), (33, "w3 w4"), (33, "w3 w4")]
    q = spark.createDataFrame([(*x, "clash") for x in items], "item_id int, text string, score string")
    got = norm_search.rank_documents(spark.createDataFrame(docs, DOCS).repartition(3), q).collect()
    want = brute_search([(r[0], r[1]) for r in docs], list(dict.fromkeys(items)))
    assert sorted((tuple(r) for r in got), key=str) == want


def test_search_of_odd_and_no_documents(spark, odd_docs, no_docs):
    df, rows = odd_docs
    items = [(1, "one TWO"), (2, "w"), (3, "x" * 20_000), (4, "endoftext 12345 it")]
    q = spark.createDataFrame(items, "item_id int, text string")
    assert sorted((tuple(r) for r in norm_search.rank_documents(df, q).collect()), key=str) == brute_search([(r[0], r[1]) for r in rows], items)
    assert norm_search.rank_documents(no_docs, q).collect() == []
    assert norm_search.rank_documents(df, q.limit(0)).collect() == []
    named = df.selectExpr("'d' || doc_id AS doc_id", "text")
    assert {r["doc_id"][:1] for r in norm_search.rank_documents(named.where("doc_id IS NOT NULL"), q).collect()} == {"d"}


def test_long_texts_are_split_in_stretches(monkeypatch):
    monkeypatch.setattr(norm_search, "_STRETCH", 16)
    text = "Straße und ÄÖ-x1 " * 50
    got = [w.decode() for part in norm_search.terms_of(text.encode()) for w in part]
    assert got == re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
    assert unicodedata.normalize("NFC", "".join(got)) == "".join(got)


def test_op13_query(spark):
    d, b = texts(), pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    got = sorted((tuple(r) for r in queries.op13_norm_search(spark, SF).collect()), key=str)
    assert got == brute_search(list(zip(d["doc_id"], d["text"], strict=True)), list(zip(b["item_id"], b["text"], strict=True)))
