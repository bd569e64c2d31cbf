"""Streams of change events: debounce, windows, lockouts, sessions, incremental ingest. Each takes a batch or a
streaming DataFrame alike and gives the same rows for both.

What depends on the order of events is a ``Machine`` that is led over the events of a key by time. A batch is
dealt by key, sorted and read in one pass. On a stream events wait in keyed state until the watermark has
passed their time, and a timer hands them to the machine in order: events may come in any order within
``late``, and those that come later than that are dropped by the watermark, as for windows. A second timer
clears the state of a key as soon as the machine says that it is as good as new. Streams with machines need
the state store ``ROCKS`` (``spark.sql.streaming.stateStore.providerClass``)."""

from __future__ import annotations

import json
import math
import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from ..sources.tables import KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming else events


def debounce(events: DataFrame, keys: list[str], gap: str, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """Trailing edge: of the events of a key less than ``gap`` apart, the last one's kind, at its time; at
    equal times the one with the largest ``tie``, or the largest kind."""
    grouped = _marked(events, ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.max_by(kind, F.struct(ts, tie or kind)).alias(kind), F.max(ts).alias("at"), F.count("*").alias("n_events")).drop("w")


def moved(events: DataFrame) -> DataFrame:
    """A move is a deletion of the source and a creation of the destination."""
    two = F.array(F.struct(F.lit("deleted").alias("event_type"), F.col("path").alias("path")), F.struct(F.lit("created").alias("event_type"), F.col("dest").alias("path")))
    one = F.array(F.struct(F.col("event_type").alias("event_type"), F.col("path").alias("path")))
    return events.select("ts", F.explode(F.when(F.col("event_type") == "moved", two).otherwise(one)).alias("e")).select("ts", "e.event_type", "e.path")


def tumbling(events: DataFrame, width: str, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    w = _marked(events, ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def failure_windows(events: DataFrame, keys: list[str], failures: int = 5, within: str = "300 seconds", slide: str = "60 seconds", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sliding windows in which a key has failed too often."""
    w = _marked(events, ts, late).groupBy(F.window(ts, within, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.filter(F.col("n") >= failures).select(F.col("w.start").alias("start"), *keys, "n")


class Machine(ABC):
    """A state machine over the events of a key. States are JSON objects; ``output`` names the columns it adds."""

    output: str

    def start(self) -> dict:
        return {}

    @abstractmethod
    def step(self, state: dict, at: float, row: dict) -> tuple | None:
        """Change ``state`` by an event; the values of ``output``, or none for an event that gives no row."""

    def idle_from(self, state: dict) -> float | None:
        """The time from which ``state`` is as good as a new one; none for never."""
        return None


class _InOrder(StatefulProcessor):
    """Leads a machine over a stream's events as the watermark passes them."""

    def __init__(self, machine: Machine, names: list[str], added: list[str], ts: str, order: list[str]):
        self.machine, self.names, self.added, self.ts, self.order = machine, names, added, ts, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, event binary")
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for batch in rows:
            for event in batch[self.names].astype(object).itertuples(index=False, name=None):
                at = float(event[self.names.index(self.ts)])
                self.waiting.appendValue((at, pickle.dumps(event)))
                due.add(math.ceil(at * 1000))
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        events = [(at, pickle.loads(event)) for at, event in (self.waiting.get() if self.waiting.exists() else ())]
        place = [self.names.index(c) for c in self.order]
        ready = sorted((e for e in events if math.ceil(e[0] * 1000) <= now), key=lambda e: (e[0], *(e[1][k] for k in place)))
        state, out = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start(), []
        for at, event in ready:
            made = self.machine.step(state, at, dict(zip(self.names, event, strict=True)))
            if made is not None:
                out.append((*event, *made))
        left = [(at, pickle.dumps(event)) for at, event in events if math.ceil(at * 1000) > now]
        if ready:
            self.waiting.put(left) if left else self.waiting.clear()
        idle = self.machine.idle_from(state)
        if idle is not None and math.ceil(idle * 1000) <= now:
            self.state.clear()
        elif ready:
            self.state.update((json.dumps(state),))
            if idle is not None:
                self.handle.registerTimer(math.ceil(idle * 1000))
        if out:
            yield pd.DataFrame(out, columns=[*self.names, *self.added], dtype=object)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, ts: str, order: list[str], machine: Machine, late: str = "10 minutes") -> DataFrame:
    """``events`` (``ts`` in seconds) with the machine's output, led over the events of each ``key`` by time, then by
    ``order``. Events without a key or a time are left out."""
    names = events.columns
    added = _parse_datatype_string(machine.output)
    schema = StructType([*events.schema.fields, *added.fields])
    known = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    if events.isStreaming:
        marked = known.withColumn("_at", F.timestamp_seconds(F.col(ts))).withWatermark("_at", late)
        return marked.groupBy(key).transformWithStateInPandas(_InOrder(machine, names, added.names, ts, order), schema, "Append", "EventTime")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, machine.start()
        for batch in batches:
            out = []
            for event in batch.astype(object).itertuples(index=False, name=None):
                row = dict(zip(names, event, strict=True))
                if row[key] != last:
                    last, state = row[key], machine.start()
                made = machine.step(state, float(row[ts]), row)
                if made is not None:
                    out.append((*event, *made))
            yield pd.DataFrame(out, columns=schema.names, dtype=object)

    return known.repartition(key).sortWithinPartitions(key, ts, *order).mapInPandas(run, schema)


FAILURES, WITHIN, LOCKED, SESSION = 5, 300.0, 60.0, 1800.0


class Lockout(Machine):
    """An attempt during a lockout is 'locked' whatever it was and counts for nothing; the ``failures``-th failure
    within ``within`` seconds locks for ``locked`` seconds; a success clears the failures."""

    output = "outcome string, locked_until double"

    def __init__(self, ok: str, failures: int, within: float, locked: float):
        self.ok, self.failures, self.within, self.locked = ok, failures, within, locked

    def start(self) -> dict:
        return {"recent": [], "until": 0.0}

    def step(self, state: dict, at: float, row: dict) -> tuple:
        if at < state["until"]:
            outcome = "locked"
        elif row[self.ok]:
            state["recent"], state["until"] = [], 0.0
            outcome = "ok"
        else:
            state["recent"] = [x for x in state["recent"] if at - x < self.within][-self.failures :] + [at]
            if len(state["recent"]) >= self.failures:
                state["until"] = at + self.locked
            outcome = "failed"
        return outcome, state["until"] if state["until"] > at else None

    def idle_from(self, state: dict) -> float:
        return max([state["until"], *(x + self.within for x in state["recent"])])


def attempt_outcomes(attempts: DataFrame, key: str, ts: str, ok: str, failures: int = FAILURES, within: float = WITHIN, locked: float = LOCKED, late: str = "10 minutes") -> DataFrame:
    """``attempts`` (ts in seconds) with (outcome, locked_until) of ``Lockout``; failures come first at equal times.
    Of a key only its last few failures are held."""
    return in_order(attempts, key, ts, [ok], Lockout(ok, failures, within, locked), late)


class Session(Machine):
    """A check is valid while the newest grant is not revoked and not older than ``seconds``."""

    output = "valid boolean"

    def __init__(self, seconds: float):
        self.seconds = seconds

    def step(self, state: dict, at: float, row: dict) -> tuple | None:
        if row["side"] == 0:
            state.update(at=at, revoked=bool(row["revoked"]))
            return None
        return (bool(state) and not state["revoked"] and at <= state["at"] + self.seconds,)

    def idle_from(self, state: dict) -> float | None:
        return None if not state else state["at"] if state["revoked"] else math.nextafter(state["at"] + self.seconds, math.inf)


def session_checks(grants: DataFrame, checks: DataFrame, seconds: float = SESSION, late: str = "10 minutes") -> DataFrame:
    """``checks`` (token, ts, check_id) with ``valid``: the token was granted at or before ts, was not
    revoked since (``grants`` has token, ts, revoked), and is not older than ``seconds``. Grants come before checks
    of the same time, revocations after other grants."""
    both = grants.select("token", "ts", F.lit(0).alias("side"), "revoked", F.lit(None).cast(checks.schema["check_id"].dataType).alias("check_id"))
    both = both.unionByName(checks.select("token", "ts", F.lit(1).alias("side"), F.lit(None).cast("boolean").alias("revoked"), "check_id"))
    both = both.withColumn("rank", F.when(F.col("side") == 1, 2).otherwise(F.coalesce("revoked", F.lit(False)).cast("int")))
    return in_order(both, "token", "ts", ["rank"], Session(seconds), late).select("check_id", "token", "ts", "valid")


def ingest(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]):
    """Run what is there through ``merge(batch, batch_id)`` and stop; a restart goes on after the last
    committed batch. ``merge`` must write by batch id to be exactly-once."""
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merge_into(table: KeyedTable, stream: str, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``merge`` that upserts each batch into ``table`` exactly once: the commit records the batch's number, so
    one that is run again after a failure changes nothing. Readers see whole committed batches."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, order, batch=(stream, batch_id))

    return merge
