"""A bounded window of model calls in flight inside one task.

Calls wait for a service most of their time, so a task keeps several of them open: requests are taken from the task's input
only when there is room, and replies leave in the order in which they come. Each call has a time limit, is tried
again after a pause that doubles, and waits for its turn where the calls of all tasks share a rate.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

ModelCall = Callable[[Sequence[str]], Sequence["str | None"]]
Answer = tuple["str | None", "str | None"]      # reply body, error


@dataclass(frozen=True)
class CallPolicy:
    """How the calls of a stage are made.

    ``window`` calls are in flight in each task at a time; above 1 the model's function is called from several threads.
    ``batch_size`` requests make one call; a batch that fails is asked again one by one. ``parallelism`` fixes the number of tasks.
    ``timeout`` (seconds) bounds one try; ``attempts`` is how often a call is tried, with ``backoff`` seconds before the
    second try, twice as many before the third, and so on. ``rate`` is the greatest number of calls a second over all
    tasks of the stage: each of the tasks that can run at a time has an equal part of it.
    """

    window: int = 16
    batch_size: int = 1
    parallelism: int | None = None
    timeout: float | None = None
    attempts: int = 1
    backoff: float = 0.5
    rate: float | None = None

    def __post_init__(self) -> None:
        if self.window < 1 or self.batch_size < 1 or self.attempts < 1:
            raise ValueError("window, batch size and attempts are 1 or more")
        if any(x is not None and x <= 0 for x in (self.timeout, self.rate, self.parallelism)) or self.backoff < 0:
            raise ValueError("time limit, rate and parallelism are above 0, the pause is not below 0")


class Turns:
    """Turns at equal intervals, handed out to all threads of a task."""

    def __init__(self, rate: float | None) -> None:
        self.interval, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.interval:
            return
        with self.lock:
            turn = max(self.next, time.monotonic())
            self.next = turn + self.interval
        time.sleep(max(0.0, turn - time.monotonic()))


class _Work:
    """One call on its way: the keys and bodies of its requests and the tries made."""

    def __init__(self, keys: list, bodies: list[str], tries: int = 0) -> None:
        self.keys, self.bodies, self.tries = keys, bodies, tries
        self.since: float | None = None         # when the current try began
        self.dead = False                       # given up; what still comes back is ignored


class Window:
    """Up to ``policy.window`` calls at a time, in threads that do not outlive the process."""

    def __init__(self, call: ModelCall, policy: CallPolicy, rate: float | None = None) -> None:
        self.call, self.policy, self.turns = call, policy, Turns(rate)
        self.todo: queue.SimpleQueue = queue.SimpleQueue()
        self.done: queue.SimpleQueue = queue.SimpleQueue()
        self.flying: set[_Work] = set()
        for _ in range(policy.window):
            self._hire()

    def _hire(self) -> None:
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while (work := self.todo.get()) is not None:
            if work.tries:
                time.sleep(self.policy.backoff * 2 ** (work.tries - 1))
            self.turns.wait()
            work.since = time.monotonic()
            try:
                replies = self.call(work.bodies)
                if len(replies) != len(work.bodies):
                    raise ValueError(f"{len(replies)} replies to {len(work.bodies)} requests")
                outcome = list(replies), None
            except Exception as failure:
                outcome = None, f"{type(failure).__name__}: {failure}"
            self.done.put((work, *outcome))
            if work.dead:
                return          # another thread has taken this one's place

    def _start(self, work: _Work) -> None:
        self.flying.add(work)
        self.todo.put(work)

    def _settle(self, work: _Work, replies: list | None, error: str | None) -> Iterator[tuple[object, Answer]]:
        """What comes of a finished try: answers, another try, or a batch asked one by one."""
        self.flying.discard(work)
        if replies is not None:
            yield from ((key, (reply, None)) for key, reply in zip(work.keys, replies))
        elif len(work.bodies) > 1:
            for key, body in zip(work.keys, work.bodies):
                self._start(_Work([key], [body]))
        elif work.tries + 1 < self.policy.attempts:
            self._start(_Work(work.keys, work.bodies, work.tries + 1))
        else:
            yield work.keys[0], (None, error)

    def _overdue(self) -> list[_Work]:
        if self.policy.timeout is None:
            return []
        limit = time.monotonic() - self.policy.timeout
        return [work for work in self.flying if work.since is not None and work.since < limit]

    def answers(self) -> Iterator[tuple[object, Answer]]:
        """Wait for the next call to end, or to run out of time."""
        try:
            work, replies, error = self.done.get(timeout=None if self.policy.timeout is None else self.policy.timeout / 20)
        except queue.Empty:
            for work in self._overdue():
                work.dead = True
                self._hire()
                yield from self._settle(work, None, f"TimeoutError: no reply in {self.policy.timeout:g} s")
            return
        if not work.dead:
            yield from self._settle(work, replies, error)

    def ask(self, requests: Iterator[tuple[object, str]]) -> Iterator[tuple[object, Answer]]:
        """(key, answer) of every (key, body), in the order in which the answers come."""
        keys, bodies = [], []
        for key, body in requests:
            keys.append(key)
            bodies.append(body)
            if len(bodies) == self.policy.batch_size:
                self._start(_Work(keys, bodies))
                keys, bodies = [], []
            while len(self.flying) >= self.policy.window:
                yield from self.answers()
        if bodies:
            self._start(_Work(keys, bodies))
        while self.flying:
            yield from self.answers()

    def close(self) -> None:
        for _ in range(self.policy.window):
            self.todo.put(None)
