"""Files that keep arriving: each is read once, and waves come to what one batch comes to."""

from __future__ import annotations

import dataclasses
import glob
import os
import random
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from test_files import FILES
from test_inference import stub_models
from tallyfolio.operators.inference import text_model
from tallyfolio.plans.batch import score_batch
from tallyfolio.sources.files import list_folders
from tallyfolio.sources.results_table import ResultsTable
from tallyfolio.streaming.intake import Arrivals, each_arrival, score_stream, uploads
from tallyfolio.streaming.latest import LatestNames
from tallyfolio.streaming.ledger import Ledger
from tallyfolio.workspace import SHUFFLE_CLEANUP, materialize, scratch, shared_folder


def put(folder, path, content, seconds):
    file = folder / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(content)
    os.utime(file, (1_700_000_000 + seconds, 1_700_000_000 + seconds))


def new_table(spark, tmp_path):
    return ResultsTable(spark, f"results_{uuid.uuid4().hex}", str(tmp_path / f"results-{uuid.uuid4().hex}"))


def arrive(arrivals, handle, checkpoint):
    each_arrival(arrivals, handle, str(checkpoint)).awaitTermination(120)


def test_every_name_arrives_once(spark, tmp_path):
    landing, got = tmp_path / "landing", []

    def keep(listing, number):
        got.extend((number, r.path, r.request_id, r.content and bytes(r.content)) for r in uploads(listing).collect())

    def look():
        got.clear()
        arrive(Arrivals(spark, [str(landing)], str(tmp_path / "arrivals")), keep, tmp_path / "checkpoint")
        return sorted(got, key=str)

    for name, content in FILES.items():
        put(landing, f"r1/{name}", content, 0)
    put(landing, "top.txt", b"no request", 0)
    read = {"TXT", "txt", "docx", "pdf", "doc", "zip", "ZIP"}
    wanted = [(0, f"r1/{n}", "r1", c if n.rsplit(".")[-1] in read and n != "noext" else None) for n, c in FILES.items()] + [(0, "top.txt", "", b"no request")]
    assert [(n, p, r, c or None) for n, p, r, c in look()] == sorted([(n, p, r, c or None) for n, p, r, c in wanted], key=str)
    assert look() == []
    put(landing, "r1/sub/.late", b"", -1000)            # older than all that has been read
    put(landing, "r1/a.TXT", b"changed", 5)
    assert [(p, c) for _, p, _, c in look()] == [("r1/a.TXT", b"changed"), ("r1/sub/.late", b"")]
    assert look() == []


def test_a_failed_micro_batch_gets_the_same_files_again(spark, tmp_path):
    put(tmp_path / "landing", "r1/a.txt", b"a", 0)
    seen = []

    def handle(listing, number):
        seen.append((number, sorted(r.path for r in listing.collect())))
        if len(seen) == 1:
            raise ValueError("down")
    arrivals = Arrivals(spark, [str(tmp_path / "landing")], str(tmp_path / "arrivals"))
    with pytest.raises(StreamingQueryException):
        arrive(arrivals, handle, tmp_path / "checkpoint")
    put(tmp_path / "landing", "r1/b.txt", b"b", -5)
    arrive(arrivals, handle, tmp_path / "checkpoint")
    assert seen == [(0, ["r1/a.txt"]), (0, ["r1/a.txt"]), (1, ["r1/b.txt"])]


def test_ledger_folds_its_parts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), "n int", fold_after=3)
    for number in range(11):
        before = ledger.before(number)
        ledger.fold(number, before)
        assert sorted(r.n for r in ledger.before(number).collect()) == list(range(number))
        for _ in range(2):                  # repeated, it replaces its own part
            ledger.write(number, spark.createDataFrame([(number,)], "n int"))
        assert ledger.part(number).count() == 1 and ledger.part(number + 1) is None
    assert len(os.listdir(tmp_path / "ledger" / "parts")) <= 3 and len(os.listdir(tmp_path / "ledger" / "folded")) == 1


WAVES = [
    [("r1/a/cv.txt", b"first", 1), ("r1/a/x.txt", b"only", 1), ("r2/cv.txt", b"other request", 9)],
    [("r1/b/cv.txt", b"third", 30), ("r1/b/.y.txt", b"hidden", 2), ("r1/b/empty.txt", b"", 3)],
    [("r1/c/cv.txt", b"second, but late", 20), ("r1/a/x.txt", b"written again", 40), ("r2/_z.txt", b"FAILASPECT", 4),
     ("r1/c/x.txt", b"older", 35), ("r2/d/cv.txt", b"at last", 50)],
]
JOBS = [("r1", "j1"), ("r2", "j2"), ("r3", "no upload")]


def outcome(table):
    """What the table says, whichever loads it came in."""
    return sorted((r.resume_name, r.resume_content, r.resume_key_aspect, -1 if r.score is None else r.score) for r in table.read().collect())


@pytest.fixture(scope="module")
def in_one_batch(spark, tmp_path_factory):
    """The files of all waves in one batch; the file that is written again is there twice."""
    tmp_path = tmp_path_factory.mktemp("batch")
    files = spark.createDataFrame([(p.split("/")[0], (1_700_000_000 + t) * 1_000_000, p.rsplit("/", 1)[1], c, p) for wave in WAVES for p, c, t in wave],
                                  "request_id string, source_seq long, name string, content binary, path string")
    table = new_table(spark, tmp_path)
    score_batch(files, spark.createDataFrame(JOBS, "request_id string, jd_text string"), stub_models(), table, "l1")
    return outcome(table)


@pytest.mark.parametrize("max_files", [3, None])
def test_waves_come_to_the_scores_of_one_batch(spark, tmp_path, in_one_batch, max_files):
    jobs = spark.createDataFrame(JOBS, "request_id string, jd_text string")
    table = new_table(spark, tmp_path)
    for wave in WAVES:
        for path, content, seconds in wave:
            put(tmp_path / "landing", path, content, seconds)
        for _ in range(0, len(wave), max_files or len(wave)):
            arrivals = Arrivals(spark, [str(tmp_path / "landing")], str(tmp_path / "arrivals"), max_files, fold_after=2)
            score_stream(arrivals, jobs, stub_models(), table, str(tmp_path / "checkpoint"), fold_after=2).awaitTermination(180)
    assert outcome(table) == in_one_batch
    assert sorted((c, s) for n, c, _, s in in_one_batch if n in ("cv.txt", "x.txt")) == [
        ("at last", 85), ("first", -1), ("older", -1), ("only", -1), ("other request", -1), ("second but late", -1), ("third", 85), ("written again", 85)]


def test_a_micro_batch_repeated_after_its_scores_changes_nothing(spark, tmp_path):
    """The keyed state is written before the scores: taking the same files again gives the same answer."""
    heads = "request_id string, name string, source_seq long, member int, unique_id string"
    latest = LatestNames(spark, str(tmp_path / "latest"))
    first = spark.createDataFrame([("r", "a", 1, -1, "u1"), ("r", "b", 5, -1, "u2"), ("r", "a", 2, -1, "u3")], heads)
    second = spark.createDataFrame([("r", "a", 3, -1, "u4"), ("r", "b", 4, -1, "u5"), ("s", "a", 1, -1, "u6")], heads)
    ids = lambda frame: sorted(r.unique_id for r in frame.collect())
    for _ in range(2):
        won, beaten = latest.take(0, first)
        assert (ids(won), ids(beaten)) == (["u2", "u3"], [])
    for _ in range(3):
        won, beaten = latest.take(1, second)
        assert (ids(won), ids(beaten)) == (["u4", "u6"], ["u3"])
    assert latest.take(2, second.limit(0))[0].count() == 0


@pytest.mark.parametrize("size", [1, 7, 40])
def test_the_last_of_a_name_does_not_depend_on_the_micro_batches(spark, tmp_path, size):
    chance = random.Random(5)
    files = [(f"r{chance.randint(0, 2)}", f"n{chance.randint(0, 3)}", chance.randint(0, 9), chance.randint(-1, 1), f"u{i}") for i in range(40 if size > 1 else 8)]
    latest, scored = LatestNames(spark, str(tmp_path / "latest"), fold_after=2), set()
    for number, a in enumerate(range(0, len(files), size)):
        won, beaten = latest.take(number, spark.createDataFrame(files[a:a + size], "request_id string, name string, source_seq long, member int, unique_id string"))
        scored = scored - {r.unique_id for r in beaten.collect()} | {r.unique_id for r in won.collect()}
    best = {}
    for request, name, *order in files:
        best[request, name] = max(best.get((request, name), []), order)
    assert scored == {order[-1] for order in best.values()}


def test_a_stream_recovers_from_a_failed_job_call(spark, tmp_path):
    put(tmp_path / "landing", "r1/cv.txt", b"text", 0)
    jobs = spark.createDataFrame([("r1", "j1")], "request_id string, jd_text string")
    table, good = new_table(spark, tmp_path), stub_models()

    def down(prompt):
        raise ValueError("down")
    for models in (dataclasses.replace(good, job=text_model(down)), good):
        arrivals = Arrivals(spark, [str(tmp_path / "landing")], str(tmp_path / "arrivals"))
        query = score_stream(arrivals, jobs, models, table, str(tmp_path / "checkpoint"))
        try:
            query.awaitTermination(120)
        except StreamingQueryException:
            assert models is not good
    assert [(r.resume_name, r.score, r.load_id) for r in table.read().collect()] == [("cv.txt", 85, "stream-0")]


def test_listing_is_left_out_by_size_and_time(spark, tmp_path):
    put(tmp_path / "landing", "r1/a.txt", b"a", 0)
    arrivals = Arrivals(spark, [str(tmp_path / "landing")], str(tmp_path / "arrivals"))
    assert arrivals.listed(0).count() == 1 and arrivals.listed(0).count() == 1 and arrivals.listed(1) is None
    put(tmp_path / "landing", "r1/a.txt", b"bb", 0)
    assert [r.length for r in arrivals.listed(1).collect()] == [2]
    assert list_folders(spark, [str(tmp_path / "landing")]).count() == 1 and arrivals.listed(2) is None
    assert "content" not in arrivals.listed(1).columns and arrivals.listed(1).filter(F.col("folder") == str(tmp_path / "landing")).count() == 1


def test_micro_batches_leave_only_what_is_read_again(spark, tmp_path):
    """Working tables go with their micro-batch, stage tables with the next one, shuffle files with their query."""
    jobs = spark.createDataFrame(JOBS, "request_id string, jd_text string")
    table, before = new_table(spark, tmp_path), spark.conf.get(SHUFFLE_CLEANUP)
    held = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/tallyfolio/*"))
    for number, wave in enumerate(WAVES[:2]):
        for path, content, seconds in wave:
            put(tmp_path / "landing", path, content, seconds)
        score_stream(Arrivals(spark, [str(tmp_path / "landing")], str(tmp_path / "arrivals")), jobs, stub_models(), table, str(tmp_path / "checkpoint")).awaitTermination(180)
        assert [n for n in os.listdir(tmp_path / "checkpoint" / "stages") if not n.startswith(".")] == [str(number)]
        assert set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/tallyfolio/*")) == held
    assert table.read().count() == 6 and spark.conf.get(SHUFFLE_CLEANUP) == before


def test_scratch_removes_its_own_tables_alone(spark):
    before, folders = spark.conf.get(SHUFFLE_CLEANUP), lambda frame: [os.path.exists(p.removeprefix("file://")) for p in frame.inputFiles()]
    outer = materialize(spark.range(3), "outer")
    with scratch(spark):
        middle = materialize(spark.range(5), "middle")
        with pytest.raises(ValueError), scratch(spark):
            inner = materialize(spark.range(4), "inner")
            files = [p.removeprefix("file://") for p in inner.inputFiles()]
            assert inner.repartition(3).groupBy("id").count().count() == 4 and spark.conf.get(SHUFFLE_CLEANUP) == "true"
            raise ValueError("down")
        assert not any(map(os.path.exists, files)) and middle.count() == 5 and spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert not any(folders(middle)) and all(folders(outer)) and outer.count() == 3
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
