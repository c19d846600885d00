"""The audit fold over a stream of connector events, with state per request.

State holds what a later event can still change: the last advertise by order key, and the
materialisations, which a later advertise turns from kept into superseded. Mass that comes late is
never dropped; it goes to the superseded counter, as in the batch fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reprise.operators import audit
from reprise.operators.quarantine import valid_events

OUT = "request_id string, advertised_tokens bigint, advertised_boundary bigint, advertise_count bigint, materialized_tokens bigint, superseded_tokens bigint, event_count bigint"


_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _row(key: tuple, s: dict) -> pd.DataFrame:
    kept = sum(t for line, t in s["made"] if line >= s["line"])
    late = sum(t for line, t in s["made"] if line < s["line"])
    row = (key[0], s["tokens"], s["boundary"], s["ads"], kept if s["made"] else None, late, s["n"])
    return pd.DataFrame([row], columns=_NAMES).astype({"advertised_tokens": "Int64", "advertised_boundary": "Int64", "materialized_tokens": "Int64"})


def _updater(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the request's facts are final: they are given once more, and forgotten
            row = _row(key, json.loads(state.get[0]))
            state.remove()
            yield row
            return
        yield _row(key, _update(batches, state))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return run


def _update(batches: Iterator[pd.DataFrame], state: GroupState) -> dict:
    s = json.loads(state.get[0]) if state.exists else {"o": None, "line": -1, "tokens": None, "boundary": None, "ads": 0, "made": [], "n": 0}
    whole = lambda x: None if pd.isna(x) else int(x)
    for batch in batches:
        for event, connector, rs, es, line, tokens, count, boundary in batch[["event", "connector_id", "request_seq", "event_seq", "line_id", "tokens", "token_count", "boundary"]].itertuples(index=False):
            s["n"] += 1
            if event == "semantic_span_load_advertised":
                s["ads"] += 1
                o = [connector or "", -1 if pd.isna(rs) else int(rs), -1 if pd.isna(es) else int(es), int(line)]
                if s["o"] is None or o > s["o"]:
                    s |= {"o": o, "line": int(line), "tokens": whole(count) or 0, "boundary": whole(boundary)}
            elif event == "runtime_materialized":
                s["made"].append([int(line), whole(tokens) or 0])
    state.update((json.dumps(s),))
    return s


def fold_stream(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Updated facts of every request that a micro-batch of raw `lines` speaks about, in update mode.

    A request without events for `idle_ms` of processing time is final: its facts are given a last
    time and its state is dropped, so that state holds open requests only. Events that come even
    later begin anew. Without it, as for a stream that ends, state is kept to the end.
    """
    events = audit.payloads(valid_events(lines)).where("request_id IS NOT NULL")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("request_id").applyInPandasWithState(_updater(idle_ms), OUT, "s string", "update", timeout)


def run_to_end(spark: SparkSession, updates: DataFrame, folder: str, keys: list[str], version: str) -> DataFrame:
    """Runs a stream over all that is there and returns each key's last update.

    Every micro-batch is written under its number, so that a batch that is run again after a failure
    replaces what it wrote before.
    """
    out = f"{folder}/updates"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(out).drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), version).alias("r"))
    return last.select(*keys, "r.*")
