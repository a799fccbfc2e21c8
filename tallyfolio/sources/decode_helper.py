"""Decoders run in a helper process beside each task, with a time and memory limit for every file.

A file on which a decoder hangs, takes too much memory or ends the process costs its own row: the helper is replaced and
the task goes on.
"""

from __future__ import annotations

import multiprocessing
import resource
from collections.abc import Callable, Mapping
from dataclasses import dataclass

Decoder = Callable[[bytes], str]


@dataclass(frozen=True)
class DecodeLimits:
    """Seconds a file may take, and bytes its decoding may add to the helper's address space; None is no limit."""

    seconds: float | None = 300.0
    memory: int | None = 4 << 30


def _address_space() -> int:
    with open("/proc/self/statm") as sizes:
        return int(sizes.read().split()[0]) * resource.getpagesize()


def _serve(pipe, others, decoders: Mapping[str, Decoder], memory: int | None) -> None:
    """Answer ``(route, content)`` by ``(text, error)`` until the task hangs up."""
    others.close()          # else the helper would hold its own pipe open
    if memory is not None:
        try:
            limit = _address_space() + memory
            resource.setrlimit(resource.RLIMIT_AS, (limit, limit))
        except (OSError, ValueError):
            pass            # a system without such limits, or with a lower one already
    while True:
        try:
            route, content = pipe.recv()
        except (EOFError, OSError):
            return
        try:
            answer = decoders[route](content), None
        except MemoryError:
            answer = None, "MemoryError: the decoder took more than its limit"
        except Exception as failure:
            answer = None, f"{type(failure).__name__}: {failure}"
        try:
            pipe.send(answer)
        except Exception as failure:        # an answer that is no text
            pipe.send((None, f"{type(failure).__name__}: {failure}"))


class Helper:
    """The helper of a task: started when first needed, or before; replaced when it is lost."""

    def __init__(self, decoders: Mapping[str, Decoder], limits: DecodeLimits) -> None:
        self.decoders, self.limits, self.process, self.pipe = decoders, limits, None, None

    def start(self) -> None:
        context = multiprocessing.get_context("fork")       # decoders need not be picklable
        self.pipe, other = context.Pipe()
        self.process = context.Process(target=_serve, args=(other, self.pipe, self.decoders, self.limits.memory), daemon=True)
        self.process.start()
        other.close()

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None

    def decode(self, route: str, content: bytes) -> tuple[str | None, str | None]:
        """``(text, error)`` of a file."""
        if self.process is None:
            self.start()
        try:
            self.pipe.send((route, content))
            if not self.pipe.poll(self.limits.seconds):
                self.close()
                return None, f"TimeoutError: the decoder took more than {self.limits.seconds:g} s"
            return self.pipe.recv()
        except (EOFError, OSError):
            self.process.join(5)
            code = self.process.exitcode
            self.close()
            return None, f"ChildProcessError: the decoder ended its process ({code})"
