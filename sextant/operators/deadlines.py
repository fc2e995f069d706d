"""Calls that may hang or die, each with a deadline.

A function that loops without end, in Python or in a library, can't be stopped
by an exception.  So calls run in a child process of the worker, one after the
other; a child that doesn't answer in time is killed, one that dies is noticed
at once, and in either case the next call gets a new child.  Between calls the
child waits, so a worker pays for one process, not for one a file.  Calls go to
the child by many at once, and each is answered by itself.
"""

from __future__ import annotations

import multiprocessing
import os
import signal
from collections.abc import Callable, Iterator, Sequence
from typing import Any

Answer = tuple[Any, str | None]


def _serve(pipe, functions: Sequence[Callable[[bytes], Any]]) -> None:
    """The child: answers calls until its parent is gone."""
    signal.signal(signal.SIGINT, signal.SIG_IGN)
    while True:
        try:
            calls = pipe.recv()
        except (EOFError, OSError):
            os._exit(0)
        for number, data in calls:
            try:
                answer: Answer = functions[number](data), None
            except Exception as e:  # a broken file is an answer too
                answer = None, f"{type(e).__name__}: {e}"[:200]
            try:
                pipe.send(answer)
            except (BrokenPipeError, OSError):
                os._exit(0)


class Runner:
    """Calls ``functions`` by number, each call at most ``seconds`` long."""

    def __init__(self, functions: Sequence[Callable[[bytes], Any]], seconds: float):
        self.functions, self.seconds = functions, seconds
        self.child = self.pipe = None

    def __enter__(self) -> Runner:
        return self

    def __exit__(self, *_: object) -> None:
        self._end()

    def call(self, number: int, data: bytes) -> Answer:
        """(result, error): the error names an exception, the deadline or how the child died."""
        return next(iter(self.calls([(number, data)])))

    def calls(self, left: Sequence[tuple[int, bytes]]) -> Iterator[Answer]:
        """The answers to calls (number, data), in order; those after one that fails go to a new child."""
        while left:
            if self.child is None:
                context = multiprocessing.get_context("fork")  # functions need not be pickled
                self.pipe, other = context.Pipe()
                self.child = context.Process(target=_serve, args=(other, self.functions), daemon=True)
                self.child.start()
                other.close()
            done, error = 0, f"DeadlineExceeded: not done after {self.seconds:g} s"
            try:
                self.pipe.send(left)
                while done < len(left) and self.pipe.poll(self.seconds):
                    answer = self.pipe.recv()
                    done += 1
                    yield answer
            except (EOFError, OSError):
                self.child.join()
                error = f"ReaderDied: exit code {self.child.exitcode}"
            if done == len(left):
                return
            self._end()
            yield None, error
            left = left[done + 1 :]

    def _end(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = self.pipe = None
