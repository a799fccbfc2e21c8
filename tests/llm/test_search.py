"""Lexical search, periodic runs and token counts against SQL, brute force and the library."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from conftest import SF_DIR, plan_of
from tallyfolio.llm import lexical_search as ls
from tallyfolio.llm import periodic_runs as pr
from tallyfolio.llm import token_counts as tc
from tallyfolio.llm.text_queries import SEARCH, op11, op12, op13
from tallyfolio.llm.words import mix

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id bigint, text string, item_id int, rank string"


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- lexical search ---

def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def ranked(docs, items, k=10):
    """The contract, word by word: {item: [(score, doc_id)]}."""
    found = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = {}
    for item in {i for i, _ in items}:
        wanted = {t for i, text in items if i == item for t in terms(text)}
        scores = []
        for i, c in found:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in wanted if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out[item] = [(-s, i) for s, i in sorted(scores)[:k]]
    return out


def by_item(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.item_id), r["rank"])):
        out[r.item_id].append((r.score, r.doc_id))
        assert r["rank"] == len(out[r.item_id])
    return out


def test_search_query_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    got = op11(spark, sf_dir)
    wanted = db.execute(SEARCH)
    assert got.columns == [c[0] for c in wanted.description]
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_of_odd_texts_ties_and_repeated_rows(spark):
    docs = [(1, "The cat_sat on the MAT"), (2, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, " \t--"),
            (6, "Été ÉTÉ été 日本 cat"), (7, "mat " * 30_000), (8, "x" * 100_000 + " mat"), (None, "cat"), (9, "dog"), (-4, "the cat sat on the mat")]
    items = [(1, "cat mat"), (1, "CAT dog"), (2, None), (3, "nothing here"), (4, "ÉTÉ 日本"), (5, ""), (None, "sat")]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], DOCS).repartition(4)
    wanted = {i: found for i, found in ranked(docs, items).items() if found}
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id int, text string, score int")
    assert by_item(ls.lexical_search(df, asked).collect()) == wanted
    few = ls.lexical_search(df, asked, k=2).collect()
    assert by_item(few) == {i: found[:2] for i, found in wanted.items()}


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id int, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert ls.lexical_search(docs, items).count() == ls.lexical_search(docs, one).count() == 0
    assert ls.lexical_search(spark.createDataFrame([(1, "a", 0, "")], DOCS), items).count() == 0


def test_search_in_rounds_and_small_groups(spark, monkeypatch):
    chance = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(chance.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, draw(chance.randint(1, 60))) for i in range(700)]
    docs += [(i, docs[3][1]) for i in range(700, 900)]            # a large group of copies
    items = [(f"i{j}", draw(chance.randint(1, 8))) for j in range(25)]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    wanted = {i: found for i, found in ranked(docs, items).items() if found}
    monkeypatch.setattr(ls, "PAIRS", 30)
    monkeypatch.setattr(ls, "GROUP", 100)
    assert by_item(ls.lexical_search(df, asked).collect()) == wanted


def test_documents_are_not_shuffled(spark, sf_dir):
    plan = plan_of(op11(spark, sf_dir))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(exchanges) == 1 and "item" in exchanges[0] and "WindowGroupLimit" in plan


def sparse(chance, rows, width, most):
    edges, columns, counts = [0], [], []
    for _ in range(rows):
        own = sorted(chance.sample(range(width), chance.randint(1, most)))
        columns += own
        counts += [chance.randint(1, 10 ** chance.randint(1, 6)) for _ in own]
        edges.append(len(columns))
    return np.array(edges), np.array(columns), np.array(counts, np.int64)


@pytest.mark.parametrize("seed", range(5))
def test_no_ball_is_bounded_too_low(seed):
    chance = random.Random(seed)
    edges, columns, whole = sparse(chance, 400, 50, 12)
    if seed % 2:                        # copies: balls of radius 0
        edges, columns, whole = np.arange(0, 401) * 3, np.tile([1, 4, 9], 400), np.tile(whole[:3], 400)
    weights = np.array([chance.randint(0, 30_000) for _ in range(50)], np.int64)
    root = np.sqrt(weights.astype(float))
    tree = ls.Balls(edges, columns, whole * root[columns], whole, 50, leaf=8)
    assert sorted(tree.order) == list(range(400)) and (seed % 2 or len(tree.nodes) > 50)
    for _ in range(20):
        own = np.array(sorted(chance.sample(range(50), 6)))
        score = np.zeros(50, np.int64)
        score[own] = weights[own]
        exact = [sum(int(score[columns[p]]) * int(whole[p]) for p in range(edges[i], edges[i + 1])) for i in range(400)]
        bounds = tree.bounds(own, root[own])
        for (a, b), bound in zip(tree.nodes, bounds):
            assert bound >= max(exact[i] for i in tree.order[a:b])
        best = ls.Best(7)
        seen = ls.visit(tree, bounds, best, score, np.arange(400) * 3)
        assert list(zip(best.scores, best.ids)) == sorted(((s, i * 3) for i, s in enumerate(exact) if s > 0), key=lambda x: (-x[0], x[1]))[:7]
        assert seen <= sum(child < 0 for child in tree.left)


def test_distant_balls_are_not_visited():
    """Two languages without a common term: leaves of the other one are never looked at."""
    chance = random.Random(1)
    edges, columns, whole = sparse(chance, 512, 40, 10)
    columns = columns + 40 * (np.repeat(np.arange(512), np.diff(edges)) % 2)
    tree = ls.Balls(edges, columns, whole.astype(float), whole, 80, leaf=8)
    score = np.zeros(80, np.int64)
    score[[2, 5, 7]] = 1
    visited = ls.visit(tree, tree.bounds(np.array([2, 5, 7]), np.ones(3)), ls.Best(3), score, np.arange(512))
    assert visited < 0.5 * sum(child < 0 for child in tree.left)


# --- periodic runs ---

def brute_runs(words):
    """All runs by comparing at every distance; the smallest period by trying all smaller ones."""
    codes = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    n, out = len(codes), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end + q - start
            if length >= max(6, 4 * q):
                own = codes[start:start + length]
                if not any((own[:-d] == own[d:]).all() for d in range(1, q)):
                    out.append((start, length, q))
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapse(words, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def repeating(chance):
    out = []
    for _ in range(chance.randint(0, 6)):
        period = chance.randint(1, chance.choice([2, 5, 20]))
        base = [chance.randint(0, chance.choice([1, 2, 9])) for _ in range(period)]
        out += (base * 9)[:int(period * chance.uniform(1, 7))] + [chance.randint(0, 9) for _ in range(chance.randint(0, 4))]
    return out


def test_runs_equal_brute_force_on_texts_that_repeat():
    chance = random.Random(1)
    for _ in range(250):
        docs = [repeating(chance) for _ in range(chance.randint(1, 6))]
        hashes = mix(np.array([w for doc in docs for w in doc], np.uint64) + np.uint64(5))
        got = list(zip(*[x.tolist() for x in pr.word_runs(hashes, np.array([len(doc) for doc in docs]))]))
        assert got == [(i, *run) for i, doc in enumerate(docs) for run in brute_runs(doc)]


def test_runs_query_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in op12(spark, sf_dir).collect()}
    texts = texts_of(spark, sf_dir)
    assert set(got) == set(texts)
    some = 0
    for i, text in texts.items():
        words, h = split(text), zlib.crc32(str(i).encode())
        n = len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = brute_runs(words)
        best = max(runs, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        listed = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_runs_of_odd_texts(spark):
    long = "a b c d e " * 30_000
    texts = [None, "", " \n\t", "x", "a a a a a", "a a a a a a", "A a A a a A", "a　b " * 6, "é  é\té\né\x0bé\x0cé\ré", "a b " * 4, "p q r " * 3 + "p q",
             " ".join(f"w{i}" for i in range(20_000)), long, "z " * 70_000 + "end", "a a a a a a b " * 5]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts)] + [(5, texts[5], 1, "r"), (None, texts[5], 1, "r")],
                               "doc_id bigint, text string, runs int, n_words string").repartition(3)
    rows = pr.periodic_runs(df).collect()
    assert len(rows) == len(texts) + 2 and sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        words = split(texts[5 if r.doc_id is None else r.doc_id])
        if len(words) < 10_000:
            runs = brute_runs(words)
        else:
            runs = {12: [(0, 150_000, 5)], 13: [(0, 70_000, 1)]}.get(r.doc_id, [])
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        assert r.collapsed == (" ".join(words[:5]) if r.doc_id == 12 else "z end" if r.doc_id == 13 else collapse(words, runs))
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_ties_of_the_strongest_run(spark, tmp_path):
    """Of runs of equal exponent the one that starts first, of those the shorter period."""
    spark.createDataFrame([(4, "b b b b b b x y y y y y y"), (5, "p p p p p p p q " + "u v " * 5)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert all(zlib.crc32(str(i).encode()) % 10 for i in (4, 5))
    rows = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in op12(spark, str(tmp_path)).collect()}
    assert rows == {4: (2, 0, 6, 1, 6000), 5: (2, 0, 7, 1, 7000)}


# --- token counts ---

@pytest.fixture(scope="module")
def library():
    coding = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: len(coding.encode(text or "", add_special_tokens=False).ids)


ODD = [None, "", " ", "\n\t ", "It's we'll  they've", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|endof text|>", "ＡＢＣ ﬁ ① ½ ١٢٣",
       "é ́x́ a ̸", "ΑΣ ΑΣ. ΟΔΟΣ", " a　b c\x85d", "日本語 😀😀 🏳️‍🌈", "İstanbul Straße", "!!!??? ... '' 's 'S", "\x00\x01 \x1c\x1d", "ａ​ｂ", "don't'll",
       "x" * 3_000_000, ("word " * 700_000), "a" * 1_500_000 + " " + "b1" * 900_000, "é" * 1_200_000 + "　" + "z"]


def test_counts_equal_the_library(spark, library):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(4, ODD[4], 5), (None, ODD[4], 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").repartition(3)
    got = tc.token_counts(df, public_tokenizers.path("word_bpe_49k.json"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        text = ODD[4 if r.doc_id is None else r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len((text or "").encode()), library(text)), r.doc_id
    assert tc.token_counts(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_counts_do_not_depend_on_what_is_kept(library):
    chance = random.Random(9)
    signs = list("ab'sé ,.\n\t<|>end1٣́日😀ＡΣ")
    texts = ["".join(chance.choices(signs, k=chance.randint(0, 60))) for _ in range(800)]
    wanted = [library(t) for t in texts]
    counter = tc.Counter(public_tokenizers.path("word_bpe_49k.json"), kept_words=50, kept_bytes=300)
    got = [n for a in range(0, 800, 40) for n in counter.counts(pa.array(texts[a:a + 40])).tolist()]
    assert got == wanted


def test_long_texts_are_cut_at_white_space():
    data = np.frombuffer(("wort " * 1000 + "x" * 5000 + " y").encode(), np.uint8)
    pieces = list(tc.stretches(data, 100))
    assert b"".join(pieces) == data.tobytes() and len(pieces) > 40
    assert all(piece[:1] == b" " for piece in pieces[1:])


def test_token_query(spark, sf_dir, library):
    texts = texts_of(spark, sf_dir)
    rows = op13(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
