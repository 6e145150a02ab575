"""Run an event rule over a batch table or over a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sessionloom.operators.sequence import islands, order_sessions
from sessionloom.streaming.rules import Rule

SESSION = "session_id"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _columns(rule: Rule) -> list[str]:
    return [part.split()[0] for part in rule.output.split(",")]


def run_batch(events: DataFrame, rule: Rule, pause: float | None = None) -> DataFrame:
    """Rule over a finished table, events in (ts, line_no) order.

    ``pause``: after a longer silence the rule starts afresh anyway, so a session is cut there and its
    parts run in parallel.  Rows stream through the task; only the rule's state is held.
    """
    so = order_sessions(events, SESSION, ("ts", "line_no"))
    if pause is None:
        rows = so.df.withColumn("_chain", F.lit(0))
    else:
        so = so.neighbours(prev={"_prev": "ts"})
        rows = islands(so, F.coalesce(F.col("ts") - F.col("_prev") > pause, F.lit(True)), "_chain").df.drop("_prev")
    columns = [SESSION, *_columns(rule)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, state = None, rule.new_state()
        for part in parts:
            out = []
            for event in part.to_dict("records"):
                here = (event[SESSION], event["_chain"])
                if here != place:
                    if place is not None:
                        out += [(place[0], *row) for row in rule.flush(state)]
                    place, state = here, rule.new_state()
                state, rows = rule.feed(state, event)
                out += [(place[0], *row) for row in rows]
            yield pd.DataFrame(out, columns=columns)
        if place is not None:
            yield pd.DataFrame([(place[0], *row) for row in rule.flush(state)], columns=columns)

    ordered = rows.repartition(SESSION, "_chain").sortWithinPartitions(SESSION, "_chain", "ts", "line_no")
    return ordered.mapInPandas(run, f"{SESSION} string, {rule.output}")


class RuleProcessor(StatefulProcessor):
    """One rule per session key; the state is a small JSON text, the timer ends an open burst."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        self.columns = [SESSION, *_columns(rule)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else self.rule.new_state()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One micro-batch of one session; its size is bounded by the source's rate options.
        batch = pd.concat(list(rows)).sort_values(["ts", "line_no"])
        state, out = self._load(), []
        for event in batch.to_dict("records"):
            state, emitted = self.rule.feed(state, event)
            out += [(key[0], *row) for row in emitted]
        self._save(state)
        yield pd.DataFrame(out, columns=self.columns)

    def _save(self, state: dict) -> None:
        self.state.update((json.dumps(state),))
        due = self.rule.deadline(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(int(due * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        out = [(key[0], *row) for row in self.rule.flush(state)]
        self.state.update((json.dumps({k: v for k, v in state.items() if k in self.rule.lasting}),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, rule: Rule, delay: str = "10 minutes") -> DataFrame:
    """Rule over a stream with columns session_id, ts, line_no, kind and what the rule reads.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    return timed.groupBy(SESSION).transformWithStateInPandas(
        statefulProcessor=RuleProcessor(rule), outputStructType=f"{SESSION} string, {rule.output}", outputMode="Append", timeMode="EventTime"
    )
