"""Sequential rules per key: rows are dealt and sorted by key and time, and one small state moves along.

No key's history is held; a task keeps one state at a time and streams through its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Breaker:
    """Opens after ``failures`` in a row; ``recovery`` seconds later lets one call probe it."""

    schema = "allowed boolean, state string"

    def __init__(self, failures: int = 5, recovery: float = 60.0):
        self.failures, self.recovery = failures, recovery
        self.state, self.fails, self.opened = "closed", 0, 0.0

    def step(self, ts: float, ok: bool) -> tuple[bool, str]:
        if self.state == "open":
            if ts - self.opened < self.recovery:
                return False, self.state
            self.state = "half_open"
        if ok:
            self.state, self.fails = "closed", 0
        else:
            self.fails += 1
            if self.fails >= self.failures:
                self.state, self.opened = "open", ts
        return True, self.state


class Throttle:
    """Accepts an update whose fingerprint is not the last accepted one, ``interval`` seconds after that."""

    schema = "accepted boolean"

    def __init__(self, interval: float = 600.0):
        self.interval, self.at, self.fingerprint = interval, None, None

    def step(self, ts: float, fingerprint: str | None) -> tuple[bool]:
        if fingerprint == self.fingerprint or (self.at is not None and ts - self.at < self.interval):
            return (False,)
        self.at, self.fingerprint = ts, fingerprint
        return (True,)


class TtlCache:
    """A miss stores the value, which expires ``ttl`` seconds after it was stored, read or not."""

    schema = "hit boolean"

    def __init__(self, ttl: float = 300.0):
        self.ttl, self.set_at = ttl, None

    def step(self, ts: float) -> tuple[bool]:
        if self.set_at is not None and ts < self.set_at + self.ttl:
            return (True,)
        self.set_at = ts
        return (False,)


class Summary:
    """Joins texts by line ends and keeps the last ``cap`` characters."""

    schema = "n int, summary string"

    def __init__(self, cap: int = 1500):
        self.cap, self.n, self.text = cap, 0, ""

    def step(self, text: str | None) -> tuple[int, str]:
        self.n += 1
        self.text = f"{self.text}\n{text or ''}".strip(" \t\n\r\f\v")[-self.cap :]
        return self.n, self.text


def fold(df: DataFrame, by: list[str], order: list[str], values: list[str], machine: Callable[[], object], last_only: bool = False) -> DataFrame:
    """``by``, ``order`` and the machine's columns for each row, or for the last row of each key.

    ``machine`` makes a fresh state with ``step(*values)``; null keys are a key of their own.
    """
    kept = list(dict.fromkeys([*by, *order]))
    wanted = list(dict.fromkeys([*kept, *values]))
    own = T.StructType.fromDDL(machine().schema)
    schema = T.StructType([*(df.schema[c] for c in kept), *own.fields])

    def run(batches):
        import pandas as pd

        key, state, waiting = object(), None, None
        for pdf in batches:
            out = []
            columns = [pdf[c].tolist() for c in wanted]
            for row in zip(*columns):
                named = dict(zip(wanted, row))
                now = tuple(None if pd.isna(named[c]) else named[c] for c in by)
                if now != key:
                    if waiting is not None and last_only:
                        out.append(waiting)
                    key, state = now, machine()
                waiting = (*(named[c] for c in kept), *state.step(*(named[c] for c in values)))
                if not last_only:
                    out.append(waiting)
            yield pd.DataFrame(out, columns=schema.names)
        if last_only and waiting is not None:
            yield pd.DataFrame([waiting], columns=schema.names)

    dealt = df.select(*wanted).repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, *order)
    return dealt.mapInPandas(run, schema)
