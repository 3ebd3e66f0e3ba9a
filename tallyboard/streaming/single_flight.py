"""One run at a time of a periodic stream: a lease beside its checkpoint, everything available in one go.

A start takes the lease, runs the stream over what has arrived and gives the lease back. A second start
while one runs is refused. A lease that was not renewed for its lifetime was left by a driver that
is gone, and may be taken over. The renewal runs beside the stream.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..sources.store import Store

LEASE = "LEASE"
#: Hours between syncs when none are set, and the least and most.
DEFAULT_HOURS, LEAST_HOURS, MOST_HOURS = 2, 1, 8


class Refused(Exception):
    """Another run holds the lease."""


def interval_seconds(hours: int | None) -> int:
    """The time between two runs: the hours within their limits."""
    return 3600 * min(MOST_HOURS, max(LEAST_HOURS, DEFAULT_HOURS if hours is None else hours))


def eligible(authenticated: bool, has_cookies: bool, any_tickets: bool) -> bool:
    """Whether a sync may start by itself."""
    return authenticated or has_cookies or any_tickets


@contextmanager
def lease(spark: SparkSession, root: str, lifetime: float = 60.0, clock: Callable[[], float] = time.time):
    """Holds the lease of ``root``, renewing it three times a lifetime; raises Refused if it is held."""
    store, mine = Store(spark, root), uuid.uuid4().hex

    def text() -> str:
        return json.dumps({"owner": mine, "until": clock() + lifetime})

    def holder() -> dict:
        try:
            return json.loads(store.read(LEASE) or "{}")
        except ValueError:
            return {}

    if not store.create(LEASE, text()):
        held = holder()
        if held.get("until", 0) > clock():
            raise Refused(f"{root} is being run")
        # of several that find it expired one moves it away, and only that one goes on
        old = f"{LEASE}-{held.get('owner', 'broken')}"
        try:
            store._rename(store.path(LEASE), store.path(old), over=False)
        except Exception as e:
            raise Refused(f"{root} was just taken over") from e
        store.delete(old)
        if not store.create(LEASE, text()):
            raise Refused(f"{root} was just taken over")
    over = threading.Event()

    def renew() -> None:
        while not over.wait(lifetime / 3):
            if holder().get("owner") == mine:
                store.replace(LEASE, text())

    thread = threading.Thread(target=renew, daemon=True)
    thread.start()
    try:
        yield mine
    finally:
        over.set()
        thread.join()
        if holder().get("owner") == mine:
            store.delete(LEASE)


def run_once(spark: SparkSession, root: str, start: Callable[[str], object], lifetime: float = 60.0) -> None:
    """Runs a stream over all that is available; ``start(checkpoint)`` starts it with trigger availableNow.

    Raises Refused if it is running already.
    """
    with lease(spark, root, lifetime):
        start(f"{root}/checkpoint").awaitTermination()


def run_periodically(spark: SparkSession, root: str, start: Callable[[str], object], hours: int | None, may_start: Callable[[], bool], stop: threading.Event) -> int:
    """Waits, then runs once if it may, again and again until ``stop``; a run that is refused is skipped. The number of runs."""
    n = 0
    while not stop.wait(interval_seconds(hours)):
        if may_start():
            try:
                run_once(spark, root, start)
                n += 1
            except Refused:
                pass
    return n
