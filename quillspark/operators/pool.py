"""Calls that wait for others, some at a time, with answers in order."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

T, R = TypeVar("T"), TypeVar("R")


def in_order(call: Callable[[T], R], items: Iterable[T], threads: int) -> Iterator[tuple[T, R]]:
    """Each item with call(item), in order, at most ``threads`` calls at a time.

    Items are taken as answers are given, so that no more than twice as many wait as there are threads. An error of a call is
    raised at its turn; calls that have not begun by then are not made.
    """
    if threads <= 1:
        for item in items:
            yield item, call(item)
        return
    waiting: deque = deque()
    pool = ThreadPoolExecutor(threads)
    try:
        for item in items:
            waiting.append((item, pool.submit(call, item)))
            if len(waiting) >= 2 * threads:
                first, answer = waiting.popleft()
                yield first, answer.result()
        while waiting:
            first, answer = waiting.popleft()
            yield first, answer.result()
    finally:
        pool.shutdown(wait=True, cancel_futures=True)
