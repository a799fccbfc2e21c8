"""The window of model calls: how many are in flight, what becomes of slow and failing ones."""

from __future__ import annotations

import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tallyfolio.operators.calls import CallPolicy, Turns, Window
from tallyfolio.operators.inference import call_model, requests, run_stage, text_model


def asked(call, policy, n=20, rate=None):
    window = Window(call, policy, rate)
    found = list(window.ask((i, f"b{i}") for i in range(n)))
    window.close()
    return found


def calls(spark, n, tasks=1):
    frame = spark.range(n, numPartitions=tasks).select(F.concat(F.lit("u"), "id").alias("unique_id"), F.concat(F.lit("p"), "id").alias("p"))
    return requests(frame, F.col("p"))


def slow_model(seconds):
    def answer(prompt):
        time.sleep(seconds)
        return f"re: {prompt}"
    return text_model(answer)


def test_calls_of_one_task_overlap(spark):
    """200 calls of 50 ms are 10 s one after the other; with 16 in flight they take less than 2."""
    wanted = calls(spark, 200)
    call_model(calls(spark, 1), slow_model(0)).collect()
    began = time.monotonic()
    got = call_model(wanted, slow_model(0.05), CallPolicy(window=16)).collect()
    assert time.monotonic() - began < 2
    assert len(got) == len({r.call_key for r in got}) == 200 and all(f"p{r.unique_id[1:]}\"" in r.body for r in got)


def test_window_bounds_what_is_in_flight_and_what_is_read():
    flying, most, read, lock = 0, 0, 0, threading.Lock()
    ahead = []

    def call(bodies):
        nonlocal flying, most
        with lock:
            flying += 1
            most = max(most, flying)
        time.sleep(0.005)
        with lock:
            flying -= 1
        return bodies

    def wanted():
        nonlocal read
        for i in range(100):
            read += 1
            yield i, str(i)

    window = Window(call, CallPolicy(window=5))
    for number, _ in enumerate(window.ask(wanted()), start=1):
        ahead.append(read - number)
    assert most == 5 and max(ahead) <= 6


def test_replies_leave_as_they_come():
    """A slow first call does not hold the others back."""
    found = asked(lambda bodies: time.sleep(0.5 if bodies == ["b0"] else 0.005) or bodies, CallPolicy(window=4))
    assert [key for key, _ in found][-1] == 0 and sorted(key for key, _ in found) == list(range(20))


def test_a_window_of_one_asks_in_order_from_one_thread():
    threads = set()
    found = asked(lambda bodies: threads.add(threading.get_ident()) or bodies, CallPolicy(window=1))
    assert [key for key, _ in found] == list(range(20)) and len(threads) == 1


def test_failures_stay_with_their_rows_and_are_tried_again():
    tries = {}

    def call(bodies):
        tries[bodies[0]] = tries.get(bodies[0], 0) + 1
        if bodies[0].endswith("3") or bodies[0] == "b5" and tries["b5"] < 3:
            raise ValueError("down")
        return bodies

    found = dict(asked(call, CallPolicy(window=4, attempts=3, backoff=0.001)))
    assert {key for key, (_, error) in found.items() if error} == {3, 13} and found[3] == (None, "ValueError: down")
    assert tries["b3"] == tries["b13"] == tries["b5"] == 3 and tries["b1"] == 1 and found[5] == ("b5", None)


def test_pauses_double():
    began = time.monotonic()
    asked(lambda bodies: 1 / 0, CallPolicy(window=1, attempts=4, backoff=0.05), n=1)
    assert 0.05 + 0.1 + 0.2 <= time.monotonic() - began < 2


def test_a_failing_batch_is_asked_one_by_one():
    sizes = []

    def call(bodies):
        sizes.append(len(bodies))
        if "b7" in bodies:
            raise ValueError("down")
        return bodies

    found = dict(asked(call, CallPolicy(window=3, batch_size=5), n=17))
    assert len(found) == 17 and [key for key, (_, error) in found.items() if error] == [7]
    assert sorted(sizes) == [1] * 5 + [2, 5, 5, 5]


def test_calls_without_an_end_cost_one_row(spark):
    """A hanging call is given up after its time, another thread takes its place, the rest goes on."""
    def answer(prompt):
        time.sleep(3600 if prompt == "p7" else 0)
        return prompt
    began = time.monotonic()
    got = {r.unique_id: r for r in run_stage(calls(spark, 60), text_model(answer), policy=CallPolicy(window=2, timeout=0.5)).collect()}
    assert time.monotonic() - began < 30 and len(got) == 60
    assert got["u7"].error == "TimeoutError: no reply in 0.5 s" and sum(r.error is not None for r in got.values()) == 1


def test_a_call_that_ran_out_of_time_is_tried_again():
    seen = []

    def call(bodies):
        seen.append(bodies[0])
        time.sleep(0.6 if bodies == ["b1"] and seen.count("b1") == 1 else 0)
        return bodies

    found = asked(call, CallPolicy(window=2, timeout=0.2, attempts=2, backoff=0.01), n=6)
    assert sorted(found) == [(i, (f"b{i}", None)) for i in range(6)] and seen.count("b1") == 2


def test_rate_is_shared_by_the_tasks_that_run_at_a_time(spark, tmp_path):
    """40 calls a second over 4 tasks: 80 calls take about 2 s, whatever the window."""
    def answer(prompt):
        (tmp_path / uuid.uuid4().hex).write_text(str(time.time()))
        return prompt
    run_stage(calls(spark, 80, 4), text_model(answer), policy=CallPolicy(window=16, parallelism=4, rate=40))
    times = sorted(float((tmp_path / name).read_text()) for name in os.listdir(tmp_path))
    assert len(times) == 80 and max(sum(t <= s < t + 1 for s in times) for t in times) <= 48
    turns, began = Turns(200), time.monotonic()
    for _ in range(21):
        turns.wait()
    assert time.monotonic() - began >= 0.1


@pytest.mark.parametrize("wrong", [{"window": 0}, {"attempts": 0}, {"batch_size": 0}, {"timeout": 0}, {"rate": -1}, {"backoff": -1}, {"parallelism": 0}])
def test_impossible_policies_are_refused(wrong):
    with pytest.raises(ValueError):
        CallPolicy(**wrong)
