"""Classifiers on held-out labels, and their parts against plain computations."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyfolio.llm import labelled, quality, toxicity
from tallyfolio.llm.classifier_queries import op7, op8

LABELS = "doc_id bigint, quality int, toxic int"


def held_out_results(rows, labels, name):
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(p == y for p, y in pairs)
    return hits / len(pairs), sum(p == y == 1 for p, y in pairs) / max(1, sum(y for _, y in pairs))


@pytest.mark.parametrize(("run", "name", "divisor", "remainder", "least"), [(op8, "quality", 5, 0, 0.95), (op7, "toxic", 4, 2, 0.85)])
def test_queries_on_held_out_labels(spark, run, name, divisor, remainder, least):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[name] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = run(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == remainder) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    accuracy, recall = held_out_results(rows, labels, name)
    assert accuracy >= least and recall >= 0.6


def toy(chance, n=240):
    good = [" ".join(chance.choices("river mountain green walk bright morning".split(), k=chance.randint(5, 60))) + "." for _ in range(n)]
    rows = []
    for i, text in enumerate(good):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text
        rows.append((i, f"{text} grobian{chance.choice('abcde')}" if toxic else text, "en", 1 - bad, int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang, _, _ in rows], "doc_id bigint, text string, lang string, label string, part bigint")
    labels = spark.createDataFrame([(i, q, t, "x") for i, _, _, q, t in rows], LABELS + ", text string")
    return docs.repartition(3), labels


def test_kept_documents_have_their_columns_and_odd_rows_do_not_break(spark):
    rows = toy(random.Random(3)) + [(9001, None, None, 1, 0), (9002, "", "en", 1, 0), (9003, "word " * 30000, "en", 1, 0), (9004, "!" * 40000, "en", 0, 0)]
    docs, labels = tables(spark, rows)
    docs = docs.unionAll(docs.where("doc_id = 1")).unionAll(docs.where("doc_id = 2").selectExpr("cast(null as bigint)", "text", "lang", "label", "part"))
    for scores, label, want in ((quality.quality_scores, "quality", 1), (toxicity.toxicity_scores, "toxic", 0)):
        found = scores(docs, labels).collect()
        assert len(found) == len(rows) + 2 and sum(r.doc_id == 1 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1
        truth = {i: (q if label == "quality" else t) for i, _, _, q, t in rows if i < 9000}
        assert sum(r.predicted == truth[r.doc_id] for r in found if r.doc_id in truth and r.held_out) >= 0.9 * sum(r.held_out for r in found if r.doc_id in truth)
        kept = scores(docs, labels, keep=True)
        assert kept.schema == docs.schema
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.predicted == want)


def test_without_labels_every_score_is_a_half(spark):
    docs, labels = tables(spark, toy(random.Random(1), 20))
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert {r.score for r in scores(docs, labels.limit(0)).collect()} == {0.5}
        assert scores(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("parts", [(0, 1, 2), (3,), ()])
def test_few_toxic_labels_do_not_drop_clean_documents(spark, parts):
    """Toxic labels in some of the parts only, or none at all."""
    rows = toy(random.Random(4), 120)
    docs, labels = tables(spark, rows)
    part = {r.doc_id: r.part for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 4) AS part").collect()}
    labels = labels.where(~labels.toxic.cast("boolean") | labels.doc_id.isin([i for i in part if part[i] in parts]))
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    clean, toxic = ([i for i, _, _, _, t in rows if t == k] for k in (0, 1))
    kept = {r.doc_id for r in toxicity.toxicity_scores(docs, labels, keep=True).collect()}
    assert kept == {i for i in found if not found[i].predicted}
    assert len(kept & set(clean)) >= 0.9 * len(clean)
    if parts:
        assert sum(found[i].predicted for i in toxic) >= 0.8 * len(toxic)
    else:
        assert all(r.score < 0.3 for r in found.values()) and len(kept) == len(rows)
    assert toxicity.toxicity_scores(docs, labels.limit(0), keep=True).count() == len(rows)


def test_held_out_labels_change_nothing(spark):
    rows = toy(random.Random(2), 120)
    turned = [(i, t, lang, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, lang, q, x in rows]
    docs, labels = tables(spark, rows)
    _, other = tables(spark, turned)
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        one, two = ({r.doc_id: r.score for r in scores(docs, x).collect()} for x in (labels, other))
        assert one == two and len(set(one.values())) > 10


def test_the_curve_sees_no_counted_row():
    """Part 3 is in no count: its labels move the curve, and neither ratios nor weights."""
    chance = np.random.default_rng(3)
    labels = np.arange(80) % 2
    rows = [np.unique(chance.integers(0, 40, 12)) + 20 * label for label in labels]
    part = np.arange(80) // 2 % 4
    one = quality.train(rows, labels, part)
    two = quality.train(rows, np.where(part == 3, 1 - labels, labels), part)
    assert (one.ratio == two.ratio).all() and (one.weight == two.weight).all() and (one.curve != two.curve).any()


def test_indicators_do_not_depend_on_the_batch():
    texts = [None, "", "a", "ab", "The cat.\nTHE CAT!!", "x" * 5000, "é è ê 12 34"]
    row, code = quality.indicators(pa.array(texts))
    for i, text in enumerate(texts):
        _, own = quality.indicators(pa.array([text], pa.string()))
        assert code[row == i].tolist() == own.tolist()


def test_descent_separates_and_stays_in_its_box():
    rows = [np.array([i % 2, 2 + i % 3]) for i in range(60)]
    values = [np.array([0.8, 0.6])] * 60
    signs = np.where(np.arange(60) % 2 == 0, 1.0, -1.0)
    w = quality.descend(rows, values, signs, np.full(60, 1.0))
    assert all(s * (w[r] @ v + w[-1] * quality.BIAS) > 0 for r, v, s in zip(rows, values, signs))


def test_histories_hold_the_signs_before_in_the_word():
    data = np.frombuffer(b"abcdefgh", np.uint8)
    history, sign, begin = toxicity.histories(data, np.array([0, 7]), np.array([7, 1]))
    assert begin.tolist() == [0, 8] and sign.tolist() == [*b"abcdefg", toxicity.END, *b"h", toxicity.END]

    def digits(x):
        out = []
        while x:
            out.append(int(x % toxicity.SIGNS) - 1)
            x //= toxicity.SIGNS
        return out
    assert [digits(h) for h in history[:8]] == [[toxicity.START], [97, toxicity.START], [98, 97, toxicity.START], [99, 98, 97, toxicity.START],
                                               [100, 99, 98, 97, toxicity.START], [101, 100, 99, 98, 97], [102, 101, 100, 99, 98], [103, 102, 101, 100, 99]]


def test_shared_chances_add_up_over_signs():
    words = [b"abc", b"abd", b"abe", b"xbc", b"b"]
    size = np.array([len(w) for w in words])
    history, sign, _ = toxicity.histories(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    chance = toxicity.shared_model(history, sign)
    assert ((chance > 0) & (chance <= 1)).all()
    for h in np.unique(history):
        _, first = np.unique(sign[history == h], return_index=True)
        assert chance[history == h][first].sum() <= 1 + 1e-9


def test_curve_follows_the_share_of_labels():
    chance = np.random.default_rng(1)
    x = np.concatenate([chance.normal(0, 1, 500), chance.normal(2, 1, 500)])[:, None]
    y = np.repeat([0, 1], 500)
    even, rare = (labelled.scored(x, labelled.logistic(x, y, share)) for share in (0.5, 0.05))
    assert even.mean() > rare.mean() and np.corrcoef(even, y)[0, 1] > 0.6
