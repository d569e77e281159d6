"""Operators whose answer depends on what came before it, on streams: keyed state, in order of event time.

Rows of a key wait until the watermark has passed their time, since an earlier one may still come; then they are
folded in order, and what the fold remembers is kept until ``forget`` seconds after the key's last row. Several
batches, in whatever order within the watermark, so give what one batch over all rows gives. A key's state holds
its memory and the rows of the watermark's delay. Rows later than the watermark are dropped by the watermark.
Keys are dealt to a fixed number of groups by their hash, and a group is called once a batch: a call costs far more
than a row. A group's state is that of its keys, so a batch writes anew what the groups it meets remember.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.streaming.ingest import TASK_EVENTS, TASK_NEXT

#: JSON: of each key its memory, its rows that wait, and when its last row was
STATE = "keys string"
GROUPS = 2048


def in_event_order(
    stream: DataFrame, key: str, time: str, carried: list[str], step: Callable[[object, int, list], tuple[object, list[tuple]]], output: str, delay: str, forget: float, groups: int = GROUPS
) -> DataFrame:
    """Fold the rows of each ``key`` by ``time`` and then by ``carried``: ``step(memory, micros, values)`` gives the next memory and output rows.

    ``memory`` starts as None and must be what JSON can hold. ``output`` is the schema of the key and of what
    ``step`` gives; keys are told apart as strings. Rows without a key form one key; rows without a time are
    dropped. A checkpoint belongs to one number of ``groups``.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    group = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(groups)).cast("int")
    rows = stream.where(F.col(time).isNotNull()).select(
        group.alias("__group"), F.col(key).cast("string").alias("__key"), F.col(time).cast("timestamp").alias("__time"), micros.alias("__at"),
        F.to_json(F.array(*(F.col(c).cast("string") for c in carried))).alias("__row"),
    )
    names = [c.strip().split(" ")[0] for c in output.split(",")]
    head, _, told_types = output.partition(",")

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # a list of pairs, since a key may be null
        known = {k: [memory, pending, last] for k, memory, pending, last in json.loads(state.get[0])} if state.exists else {}
        for frame in frames:
            for k, at, row in zip(frame["__key"].tolist(), frame["__at"].tolist(), frame["__row"].tolist(), strict=True):
                known.setdefault(k, [None, [], None])[1].append([at, row])
        now = state.getCurrentWatermarkMs()
        passed = now * 1000
        out, wake = [], None
        for k, kept in list(known.items()):
            memory, pending, last = kept
            pending.sort()
            ready = next((i for i, p in enumerate(pending) if p[0] > passed), len(pending))
            for at, row in pending[:ready]:
                memory, told = step(memory, at, json.loads(row))
                out += [(k, *t) for t in told]
                last = at
            pending = pending[ready:]
            gone = None if last is None else last + int(forget * 1_000_000)
            if not pending and gone is not None and gone <= passed:
                del known[k]
                continue
            kept[:] = memory, pending, last
            at = pending[0][0] if pending else gone
            wake = at if wake is None else min(wake, at)
        if known:
            state.update((json.dumps([(k, *kept) for k, kept in known.items()]),))
            # a timer fires once the watermark is beyond it, and must lie beyond the watermark now
            state.setTimeoutTimestamp(max(wake // 1000, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    held = rows.withWatermark("__time", delay)
    found = held.groupBy("__group").applyInPandasWithState(fold, f"{names[0]} string,{told_types}", STATE, "append", "EventTimeTimeout")
    return found.withColumn(names[0], F.col(names[0]).cast(head.strip().split(" ", 1)[1]))


def suppressed_stream(messages: DataFrame, seconds: int = 30, delay: str = "1 minute", key_type: str = "string") -> DataFrame:
    """``key, shown_us`` of messages shown, as ``registry_ops.suppressed`` gives them for a table; state goes once it can suppress nothing."""

    def step(last, at: int, _):
        return (at, [(at,)]) if last is None or at - last >= seconds * 1_000_000 else (last, [])

    return in_event_order(messages, "key", "ts", [], step, f"key {key_type}, shown_us bigint", delay, seconds)


def task_history_stream(events: DataFrame, delay: str = "1 minute", forget: float = 86_400.0, task_type: str = "string") -> DataFrame:
    """``task, state, at_us, event_id, valid`` as ``ingest.task_history`` gives them for a table.

    ``forget`` seconds after its last event a task is idle again.
    """

    def step(before, at: int, values: list):
        kind, event_id = values[1], int(values[0])
        now = TASK_EVENTS[kind]
        return now, [(now, at, event_id, now in TASK_NEXT[before or "idle"])]

    # of events at one time the smaller id comes first
    rows = events.where(F.col("type").isin(*TASK_EVENTS)).withColumn("__id", F.format_string("%020d", "event_id"))
    return in_event_order(rows, "task", "ts", ["__id", "type"], step, f"task {task_type}, state string, at_us bigint, event_id bigint, valid boolean", delay, forget)
