"""Calling outside models from column functions: batches of requests, limits by the minute, and another try when refused.

A model is a function from a list of texts to a list of results, made in the worker by a factory, so nothing that can't
be sent is sent. It runs in Arrow batches; a limit holds for each worker, so give each its share of the whole.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Refused(Exception):
    """The service asks to wait; ``after`` seconds if it says how long."""

    def __init__(self, after: float | None = None):
        super().__init__("refused")
        self.after = after


class Limiter:
    """Admits a request when both the requests and the tokens of the last ``window`` seconds leave room for it."""

    def __init__(self, requests: int, tokens: int, window: float = 60.0, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.requests, self.tokens, self.window, self.now, self.sleep = max(1, requests), max(1, tokens), max(0.1, window), now, sleep
        self.admitted: deque[tuple[float, int]] = deque()

    def acquire(self, tokens: int = 1) -> None:
        need = min(max(1, tokens), self.tokens)
        while True:
            at = self.now()
            while self.admitted and at - self.admitted[0][0] >= self.window:
                self.admitted.popleft()
            if len(self.admitted) < self.requests and sum(n for _, n in self.admitted) + need <= self.tokens:
                self.admitted.append((at, need))
                return
            self.sleep(max(0.01, self.admitted[0][0] + self.window - at + random.uniform(0.01, 0.05)))


def wait_of(attempt: int, after: float | None, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds before another try: what the service asks for, else doubling, with up to half as much again."""
    if after is not None:
        return max(0.1, after)
    wait = min(most, base * 2**attempt)
    return wait + random.uniform(0, wait / 2)


def with_retries(call: Callable, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, repeated while it is refused; after so many further tries the refusal is raised."""

    def again(*args):
        attempt = 0
        while True:
            try:
                return call(*args)
            except Refused as e:
                if attempt >= tries:
                    raise
                attempt += 1
                sleep(wait_of(attempt, e.after))

    return again


def batched(make: Callable[[], Callable[[list[str]], list]], returns: str, size: int = 50, requests: int | None = None, tokens: int | None = None, tries: int = 3) -> Callable[[Column], Column]:
    """A column function that sends texts to a model in requests of at most ``size``; null texts are not sent.

    ``make`` runs once a worker. Where requests and tokens are given, they are the worker's limits by the minute.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = with_retries(make(), tries)
        limiter = Limiter(requests or 1 << 30, tokens or 1 << 60)
        for texts in parts:
            sent = texts.dropna()
            out: list = []
            for first in range(0, len(sent), size):
                chunk = sent.iloc[first : first + size].tolist()
                limiter.acquire(sum(max(1, len(t.encode()) // 4) for t in chunk))
                out += model(chunk)
            yield pd.Series(out, index=sent.index, dtype=object).reindex(texts.index)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda column: F.pandas_udf(run, returns)(column)
