"""Calls that wait for others (pages, models), a bounded number at a time."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any


def bounded(call: Callable[[Any], Any], items: Iterable, limit: int, stop: threading.Event | None = None) -> Iterator[tuple[Any, Exception | None]]:
    """(value, None) or (None, error) of each item, in the items' order.

    At most ``limit`` calls run at once and at most twice as many results wait, so items may be a stream. An
    error is its own item's result and stops nothing. Once ``stop`` is set no call is begun; those that run
    still give their results.
    """
    with ThreadPoolExecutor(max(1, limit)) as pool:
        waiting: deque = deque()

        def outcome():
            done = waiting.popleft()
            error = done.exception()
            return (None, error) if error else (done.result(), None)

        for item in items:
            if stop is not None and stop.is_set():
                break
            waiting.append(pool.submit(call, item))
            if len(waiting) >= 2 * limit:
                yield outcome()
        while waiting:
            if stop is not None and stop.is_set() and waiting[0].cancel():
                waiting.popleft()
                continue
            yield outcome()
