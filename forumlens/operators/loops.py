"""When the driver runs its batches: all the time, at intervals, or outside the hours in which models cost more.

A step is one batch: it returns how many rows it has worked off. ``wait`` sleeps for so many seconds and is false
once the driver is to stop (``Waiter``); tests give a simulated one. A step that fails counts as one without work, so
the loop goes on after a pause.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

IDLE = 30.0
PEAK_HOURS = (14, 18)  # Monday to Friday, UTC+8
log = logging.getLogger(__name__)

Step = Callable[[], int]
Wait = Callable[[float], bool]


class Waiter:
    """Sleeps that a stop ends."""

    def __init__(self):
        self.stopped = threading.Event()

    def __call__(self, seconds: float) -> bool:
        return not self.stopped.wait(seconds)

    def stop(self) -> None:
        self.stopped.set()


def peak_seconds_left(now: int) -> int:
    """Seconds until the peak hours end; 0 outside them."""
    local = now + 8 * 3600
    weekday, second = (local // 86400 + 3) % 7, local % 86400  # 1970-01-01 was a Thursday
    first, last = (h * 3600 for h in PEAK_HOURS)
    return last - second if weekday < 5 and first <= second < last else 0


def _done(step: Step) -> int:
    try:
        return step()
    except Exception:
        log.exception("a batch failed")
        return 0


def continuous(step: Step, wait: Wait, idle: float = IDLE) -> None:
    """One batch after the other; a pause after one without work."""
    while wait(0):
        if not _done(step) and not wait(idle):
            return


def scheduled(step: Step, wait: Wait, interval: float) -> None:
    """A batch at once, then one after every interval."""
    while wait(0):
        _done(step)
        if not wait(interval):
            return


def off_peak(step: Step, wait: Wait, clock: Callable[[], int], idle: float = IDLE) -> None:
    """Like ``continuous``, but no batch is begun in the peak hours."""
    while wait(0):
        if left := peak_seconds_left(clock()):
            if not wait(left):
                return
        elif not _done(step) and not wait(idle):
            return
