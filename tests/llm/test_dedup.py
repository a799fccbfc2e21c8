"""Near copies of vectors, lines and documents against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import plan_of
from pyspark.sql import functions as F
from tallyfolio.llm import embedding_dedup, line_dedup, set_join
from tallyfolio.llm.components import components
from tallyfolio.llm.dedup_queries import SQL_DOCUMENTS, SQL_VECTORS, op1, op2, op3
from tallyfolio.llm.words import words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def classes(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def shingles(text, size=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)} if len(found) >= size else ({tuple(found)} if found else set())


def document_classes(texts, percent=80):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in classes(sets, links).items()}


def test_words_are_split_and_lowered_as_told():
    texts = ["One two\tTHREE\x0bfour", None, "", "  ", "one", "É é\x1cx", "two one"]
    row, found = words(pa.array(texts))
    assert row.tolist() == [0, 0, 0, 0, 4, 5, 5, 6, 6]
    names = ["one", "two", "three", "four", "one", "É", "é\x1cx", "two", "one"]
    assert [names.index(names[i]) == names.index(names[j]) for i in range(9) for j in range(9)] == [found[i] == found[j] for i in range(9) for j in range(9)]


def test_words_are_whole_across_chunks(monkeypatch):
    text = " ".join(f"word{i}" for i in range(2000)) + " " + "x" * 5000
    once = words(pa.array([text, "a b"]))
    monkeypatch.setattr("tallyfolio.llm.words.CHUNK", 64)
    again = words(pa.array([text, "a b"]))
    assert all((x == y).all() for x, y in zip(once, again))


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors_table():
    chance = random.Random(3)
    rows, number = [], 0
    for group in range(30):
        middle = [chance.gauss(0, 1) for _ in range(16)]
        for _ in range(group + 1):
            rows.append((number, [x + chance.gauss(0, 0.13) for x in middle], group))
            number += 1
    rows += [(1000 + i, rows[5][1], 0) for i in range(40)]                      # equal vectors
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, [float("inf")] + [1.0] * 15, 1),
             (2005, [None] + [1.0] * 15, 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [2.0 * x for x in rows[5][1]], 1)]
    return rows


@pytest.mark.parametrize("window", [8, 128])
def test_vectors_against_brute_force(spark, tmp_path, window):
    rows = vectors_table()
    usable = {i: np.array(v, float) / np.linalg.norm(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.95]
    group = classes([i for i, _, _ in rows], links)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int")
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df, window=window, recall=0.9999).collect()}
    assert {i: r.component_id for i, r in got.items()} == group
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in x for x in links) for i in group}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_pairs_in_a_crowd_of_vectors_are_found(spark, monkeypatch):
    """6,000 vectors at cosine 0.8 to each other, 200 of them with a partner at 0.952, beside 6,000 others."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 128)
    chance = np.random.default_rng(6)
    size, n = 64, 6000

    def units(k):
        x = chance.standard_normal((k, size))
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    crowd = np.sqrt(0.8) * units(1) + np.sqrt(0.2) * units(n)
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    away = units(200)
    away -= (away * crowd[:200]).sum(axis=1, keepdims=True) * crowd[:200]
    partner = 0.952 * crowd[:200] + np.sqrt(1 - 0.952 ** 2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([crowd, units(n), partner]))]
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), window=32).collect()}
    hits = sum(got[2 * n + i].component_id == got[i].component_id for i in range(200))
    print("found", hits, "of 200")
    assert len(got) == len(rows) and hits >= 199


def test_vectors_in_several_blocks_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    chance = random.Random(1)
    rows = [(i, [1.0, chance.random() / 100, 0.5]) for i in range(60)]
    got = embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_no_vectors_and_passes_grow(spark):
    assert embedding_dedup.near_embeddings(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert embedding_dedup.passes_for(10 ** 9, 0.95, 128, 0.999) > embedding_dedup.passes_for(10 ** 5, 0.95, 128, 0.999)


def test_embeddings_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in table}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    group = classes(unit, links)
    assert {r.vec_id: (r.n_links, r.component_id) for r in op1(spark, sf_dir).collect()} == {i: (sum(i in x for x in links), group[i]) for i in unit}


def texts_table():
    chance = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = " ".join(chance.choices(vocabulary, k=60))
    texts = {}
    for n in (1, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200):
        for _ in range(3):
            base = chance.choices(vocabulary, k=n)
            for copy in range(4):
                own = list(base)
                for _ in range(copy * max(1, n // 60)):
                    own[chance.randrange(n)] = chance.choice(vocabulary)
                texts[len(texts)] = " ".join(own)
    for i in range(40):     # one passage in many documents
        texts[len(texts)] = " ".join(chance.choices(vocabulary, k=30 + i)) + " " + passage
    group = chance.choices(vocabulary, k=80)
    for i in range(60):     # a large group of near copies, and one of copies
        own = list(group)
        own[chance.randrange(80)] = f"x{i}"
        texts[len(texts)] = " ".join(own)
        texts[len(texts)] = " ".join(group)
    for text in (None, "", "  \t ", "Same Words here", "same words HERE", "x" * 20000, "long " * 20000):
        texts[len(texts)] = text
    return texts


@pytest.mark.parametrize(("percent", "block"), [(80, 1024), (60, 1024), (80, 5)])
def test_documents_against_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(set_join, "BLOCK", block)
    texts = texts_table()
    rows = [(i, t, "en", "key", 1) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, sig string, n bigint").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in set_join.jaccard_classes(df, percent=percent).collect()}
    assert got == document_classes(texts, percent)


def test_deletion_plan_is_used_where_it_costs_less_and_is_exact(spark, monkeypatch):
    assert {set_join.allocate(5, 6, 10 ** 9, 80)[2], set_join.allocate(300, 374, 1000, 80)[2]} == {0, 1}
    monkeypatch.setattr(set_join, "allocate", lambda low, high, sets, percent: ((set_join.differ(high, high * 100 // percent, percent) + 2) // 2, 0, 1)
                        if set_join.differ(high, high * 100 // percent, percent) else None)
    texts = {i: t for i, t in texts_table().items() if i < 150}
    got = {r.id: (r.n_shingles, r.component_id) for r in set_join.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == document_classes(texts)


def test_documents_of_very_many_words(spark):
    one = [f"w{i}" for i in range(100_000)]
    two = [f"x{i}" if i % 2000 == 7 else w for i, w in enumerate(one)]
    far = [f"x{i}" if i % 30 == 7 else w for i, w in enumerate(one)]
    texts = {1: " ".join(one), 2: " ".join(two), 3: " ".join(far), 4: "a few words of a short text", 5: "a few words of a short text"}
    got = {r.id: (r.n_shingles, r.component_id) for r in set_join.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == document_classes(texts)
    assert [got[i][1] for i in texts] == [1, 1, 3, 4, 4]


def test_plans_are_made_for_sets_of_any_size():
    edges = set_join.band_edges(3_000_000, 80)
    for sets in (0, 10, 10 ** 9):
        for low, high in zip(edges, edges[1:]):
            plan = set_join.allocate(low, high - 1, sets, 80)
            h = set_join.differ(high - 1, (high - 1) * 100 // 80, 80)
            assert (plan is None) == (h == 0) and (plan is None or plan[0] == (h + 2) // 2 or plan[0] == h + 1 + plan[1])
    for limit, mean in ((0, 0.5), (3, 2.0), (30, 20.0), (3, 0.0)):
        assert abs(set_join.more_than(limit, mean) - (1 - sum(math.exp(-mean) * mean ** k / math.factorial(k) for k in range(limit + 1)))) < 1e-9


def test_a_sketch_never_says_less_than_what_is_shared():
    chance = np.random.default_rng(2)
    for _ in range(100):
        pool = chance.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = (np.unique(chance.choice(pool, chance.integers(1, 300))) for _ in range(2))
        one, two = (np.frombuffer(set_join.sketch(x), np.uint8) for x in (a, b))
        assert set_join.may_share(one, two) >= len(np.intersect1d(a, b))


def test_documents_query_and_no_documents(spark, sf_dir):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3(spark, sf_dir).collect()} == document_classes(table)
    assert set_join.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0
    assert set_join.jaccard_classes(spark.createDataFrame([(None, "a b c d e f"), (3, None)], "doc_id bigint, text string")).collect() == [(3, 0, 3)]


def test_distance_bits_equal_the_table(spark):
    chance = random.Random(5)
    pairs = []
    for _ in range(300):
        a = [chance.choice("abé ") for _ in range(chance.randint(1, 70))]
        b = list(a)
        for _ in range(chance.randint(0, 4)):
            at = chance.randrange(len(b) + 1)
            b[at:at + chance.randint(0, 1)] = [chance.choice("abcé")] * chance.randint(0, 1)
        a, b = sorted(("".join(a), "".join(b) or "a"), key=len, reverse=True)
        if len(a) - len(b) <= 2:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2):
        for r in df.where(F.length("a") - F.length("b") <= most).select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
            assert min(r.d, most + 1) == min(distance(r.a, r.b), most + 1), r


def deduped(texts):
    """Brute force: {id: text} without the lines that come again."""
    def trimmed(line):
        return line.strip(" \t\r")

    first = {}
    for i in sorted(texts):
        for line in (texts[i] or "").split("\n"):
            first.setdefault(trimmed(line), i)
    known = sorted(x for x in first if len(x) >= 10)
    links = []
    for n, a in enumerate(known):
        for b in known[n + 1:]:
            short = min(len(a), len(b))
            allowed = 2 if short >= 48 else 1 if short >= 24 else 0
            if allowed and abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed:
                links.append((a, b))
    group, seen, out = classes(known, links), set(), {}
    for i in sorted(texts):
        kept = []
        for line in (texts[i] or "").split("\n"):
            line_class = group.get(trimmed(line))
            if line_class is None or line_class not in seen:
                kept.append(line)
            seen.add(line_class)
        out[i] = None if texts[i] is None else "\n".join(kept)
    return out


def line_texts():
    chance = random.Random(9)
    made = ["".join(chance.choice("abcdefgh é") for _ in range(n)) for n in (9, 10, 11, 23, 24, 25, 26, 46, 47, 48, 49, 50, 51, 80, 200)]
    texts = {}
    for i in range(60):
        lines = []
        for line in chance.sample(made, 4):
            own = list(line)
            for _ in range(chance.randint(0, 3)):
                at = chance.randrange(len(own))
                own[at:at + chance.randint(0, 1)] = [chance.choice("xyzß")] * chance.randint(0, 1)
            lines.append("".join(own))
        texts[i] = "\n".join([*lines, "", "short", f"\t  {made[-1]}\r", f"only in document {i} and nowhere else"])
    texts |= {100: None, 101: "", 102: "\n\n", 103: made[-1], 104: f"{made[-2]}\n{made[-2]}", 105: "q" * 30000}
    return texts


def test_lines_against_brute_force(spark):
    texts = line_texts()
    rows = [(i, t, i % 3, "kept") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lines_removed int, id string").repartition(4)
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "id", "lines_removed"]
    found = {r.doc_id: r for r in got.collect()}
    wanted = deduped(texts)
    assert {i: r.text for i, r in found.items()} == wanted
    assert all(r.lines_removed == (texts[i] or "").count("\n") - (wanted[i] or "").count("\n") or r.text == "" for i, r in found.items())


def test_lines_give_the_same_where_sides_are_not_broadcast(spark, monkeypatch):
    texts = line_texts()
    monkeypatch.setattr(line_dedup, "FEW_ROWS", 0)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()} == deduped(texts)


def test_lines_stay_in_the_jvm_and_empty_tables_stay_empty(spark, sf_dir):
    plan = plan_of(op2(spark, sf_dir))
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow"))
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "the same long line of text"), (1, "the same long line of text"), (1, "the same long line of text")], "doc_id bigint, text string")
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(rows).collect()), key=str) == sorted(
        [(None, "the same long line of text", 0), (1, "the same long line of text", 0), (1, "the same long line of text", 0)], key=str)


@pytest.mark.parametrize(("name", "run", "folder"), [("embeddings", op1, "sf0.001"), ("documents", op3, "sf0.001"), ("documents", op3, "sf0.01")])
def test_queries_equal_their_sql(spark, name, run, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{folder}/{name}.parquet'")
    wanted = db.execute(SQL_VECTORS if run is op1 else SQL_DOCUMENTS)
    columns = [c[0] for c in wanted.description]
    assert sorted(map(tuple, run(spark, f"/root/testdata/{folder}").select(*columns).collect())) == sorted(wanted.fetchall())


def test_lines_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    exact = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            exact.setdefault(line.strip(" \t\r"), i)
    got = {r.doc_id: r for r in op2(spark, sf_dir).collect()}
    assert {i: r.n_lines for i, r in got.items()} == {i: t.count("\n") + 1 for i, t in texts.items()}
    for i, r in got.items():
        if not r.lines_removed:
            assert r.kept_md5 == hashlib.md5(texts[i].encode()).hexdigest()
    repeated = {i for i in texts for line in texts[i].split("\n") if len(line.strip(" ")) >= 10 and exact[line.strip(" \t\r")] != i}
    assert all(got[i].lines_removed > 0 for i in repeated)


def test_numbered_lines_of_one_template_make_few_pairs(spark, monkeypatch):
    """Lines that differ in their digits alone are told apart by counts, before pairs of them are written."""
    chance, made, real = random.Random(11), {}, line_dedup.materialize

    def counted(df, label):
        kept = real(df, label)
        made[label] = kept.count()
        return kept
    monkeypatch.setattr(line_dedup, "materialize", counted)
    text = "\n".join(f"Invoice {chance.randint(10**11, 10**12)} was settled in full by the customer" for _ in range(300))
    out = line_dedup.drop_repeated_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert out.text == text and out.lines_removed == 0
    assert made["matched"] > 300 and made["near"] < 20 * 300
