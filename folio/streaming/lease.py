"""One scan at a time across applications: a lease with expiry and fencing numbers, a stop request, a cooldown.

Claims are numbered files, each put exactly once; the last one counts. A claim's number is its fencing number:
tables refuse commits with a lower one than they have seen, so an owner that slept through its lease can't
write any more.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from folio.sources import storage

SECONDS = 120.0
COOLDOWN = 60.0


class ScanInProgress(RuntimeError):
    """A second scan of one registry was refused."""


class LeaseLost(RuntimeError):
    """The lease ran out and another owner took it."""


class Stopped(RuntimeError):
    """A stop was asked for; what is left waits for the next scan."""


@dataclass
class Lease:
    """A claim at ``path``. ``clock`` gives seconds; owners' clocks should agree to well under the lease's length."""

    spark: SparkSession
    path: str
    seconds: float = SECONDS
    clock: Callable[[], float] = time.time
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    number: int = 0  # of the last claim
    fence: int = 0  # of the first one
    until: float = 0.0

    def _last(self) -> tuple[int, dict]:
        names = storage.names_in(self.spark, f"{self.path}/claims")
        return (int(names[-1]), json.loads(storage.read_text(self.spark, f"{self.path}/claims/{names[-1]}"))) if names else (0, {"owner": "", "until": 0.0})

    def _claim(self, number: int, until: float) -> bool:
        if not storage.put_once(self.spark, f"{self.path}/claims/{number:012d}", json.dumps({"owner": self.owner, "until": until})):
            return False
        if self._last()[0] != number:  # the place was free only because later claims had cleared it
            return False
        self.number, self.until = number, until
        for old in storage.names_in(self.spark, f"{self.path}/claims")[:-3]:
            storage.delete(self.spark, f"{self.path}/claims/{old}")
        return True

    def acquire(self) -> Lease:
        """Take the lease if nobody holds it or its owner let it run out; else ``ScanInProgress``."""
        number, last = self._last()
        if last["until"] > self.clock() or not self._claim(number + 1, self.clock() + self.seconds):
            raise ScanInProgress(self.path)
        self.fence = self.number
        return self

    def renew(self) -> None:
        """Hold it for its whole length again; ``LeaseLost`` if another owner has it."""
        number, last = self._last()
        if last["owner"] != self.owner or not self._claim(number + 1, self.clock() + self.seconds):
            raise LeaseLost(self.path)

    def release(self) -> None:
        number, last = self._last()
        if last["owner"] == self.owner:
            self._claim(number + 1, 0.0)

    def check(self) -> None:
        """Between two groups of files: renew once half the lease is gone, and give way to a stop request."""
        if stop_requested(self.spark, self.path, self.fence):
            raise Stopped(self.path)
        if self.clock() > self.until - self.seconds / 2:
            self.renew()


def held(spark: SparkSession, path: str, clock: Callable[[], float] = time.time) -> bool:
    return Lease(spark, path)._last()[1]["until"] > clock()


def request_stop(spark: SparkSession, path: str, clock: Callable[[], float] = time.time) -> bool:
    """Ask the owner to stop before its next group of files, from any application. False if nobody holds the lease.

    The time of the request stays, so that watchers leave the folder alone for the cooldown.
    """
    if not held(spark, path, clock):
        return False
    note_stop(spark, path, clock)
    return True


def note_stop(spark: SparkSession, path: str, clock: Callable[[], float] = time.time) -> None:
    """Keep the time of a stop, under the number of the last claim; it ends no claim after that."""
    storage.put_once(spark, f"{path}/stops/{Lease(spark, path)._last()[0]:012d}", json.dumps({"at": clock()}))


def stop_requested(spark: SparkSession, path: str, fence: int) -> bool:
    """Whether a stop was asked for since the lease was taken."""
    names = storage.names_in(spark, f"{path}/stops")
    return bool(names) and int(names[-1]) >= fence


def cooling(spark: SparkSession, path: str, clock: Callable[[], float] = time.time, seconds: float = COOLDOWN) -> bool:
    """Whether the last stop request is less than ``seconds`` old."""
    names = storage.names_in(spark, f"{path}/stops")
    return bool(names) and clock() < json.loads(storage.read_text(spark, f"{path}/stops/{names[-1]}"))["at"] + seconds
