"""Streaming forms of the logs: tails, deduplication, head sets, batches, timeouts, work items and ingest."""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import requests
from ..operators.journal import FOLD, FOLD_COLUMNS, BatchFold

_STATES = pa.list_(pa.struct([(c, pa.string()) for c in ("canonical", "public", "lineage")]))
_REFS = pa.list_(pa.struct([*((c, pa.string()) for c in ("bookmark", "expected", "observed", "identity")), ("proposed", pa.int32()), ("states", _STATES)]))
_KINDS = {"sequence": pa.int64(), "at": pa.int64(), "fence": pa.int64(), "known": pa.bool_(), "durable": pa.bool_(), "refs": _REFS}
EVENTS = pa.schema([(c, _KINDS.get(c, pa.string())) for c in requests.EVENT_COLUMNS])


def tail(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Writes what is there by now as Parquet and reads it back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def dedup_stream(requests: DataFrame, key: list[str], time: str, keep: str = "7 days") -> DataFrame:
    """Requests without later ones of the same key; keys are remembered for at least the time given, by event time."""
    return requests.withWatermark(time, keep).dropDuplicatesWithinWatermark(key)


HEADS = "repo string, cursor long, heads array<string>"


def heads_stream(transactions: DataFrame) -> DataFrame:
    """(repo, cursor, heads) after each trigger for the repositories that it touched.

    transactions: (repo, cursor, new_head, observed). State per repository: its heads and cursor; a transaction that
    isn't after the cursor was applied before.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heads, cursor = (set(json.loads(state.get[0])), state.get[1]) if state.exists else (set(), 0)
        for row in pd.concat(list(batches)).sort_values("cursor").itertuples(index=False):
            if row.cursor > cursor:
                heads -= {h for h in row.observed if h is not None}
                heads.add(row.new_head)
                cursor = int(row.cursor)
        state.update((json.dumps(sorted(heads)), cursor))
        yield pd.DataFrame({"repo": [key[0]], "cursor": [cursor], "heads": [sorted(heads)]})

    return transactions.groupBy("repo").applyInPandasWithState(fold, HEADS, "heads string, cursor long", "update", GroupStateTimeout.NoTimeout)


def batches_stream(events: DataFrame) -> DataFrame:
    """The outcome of each event, as replay_batches() gives it; a repository's log is kept as state, so that an event's
    outcome depends on all before it, whichever trigger brought them."""
    from ..operators.journal import fold_batches

    columns = ["repo", "sequence", "kind", "batch_id", "bookmark", "expected", "proposed", "observed", "fence"]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = BatchFold(json.loads(state.get[0]) if state.exists else None)
        new = pd.concat(list(batches))[columns].astype({"expected": object, "proposed": object, "observed": object})
        out = kept.rows(new.sort_values("sequence", kind="stable"))
        state.update((json.dumps(kept.state()),))
        yield pd.DataFrame(out, columns=FOLD_COLUMNS)

    return events.select(*columns).groupBy("repo").applyInPandasWithState(fold, FOLD, "state string", "append", GroupStateTimeout.NoTimeout)


class StateMap(MutableMapping):
    """A map state as a mapping of texts to JSON values; only the keys asked for are read."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, k):
        if not self.state.containsKey((k,)):
            raise KeyError(k)
        return json.loads(self.state.getValue((k,))[0])

    def __setitem__(self, k, value):
        self.state.updateValue((k,), (json.dumps(value),))

    def __delitem__(self, k):
        self.state.removeKey((k,))

    def __iter__(self):
        return (k for (k,) in self.state.keys())

    def __len__(self):
        return sum(1 for _ in self)


class JournalProcessor(StatefulProcessor):
    """A repository's journal in map states; answers are forgotten by the store, too, once they are no longer kept."""

    def __init__(self, limits: requests.Limits, forget: bool):
        self.limits, self.forget = limits, forget

    def init(self, handle) -> None:
        keep = {name: self.limits.keep for name in ("results", "fetches") if self.forget}
        self.maps = {name: StateMap(handle.getMapState(name, "k string", "v string", keep.get(name))) for name in requests.MAPS}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((e for part in rows for e in pa.RecordBatch.from_pandas(part, schema=EVENTS, preserve_index=False).to_pylist()), key=lambda e: e["sequence"])
        found = requests.outcomes(requests.Journal(self.maps, self.limits), events)
        yield pd.DataFrame(found, columns=[c.split(" ")[0] for c in requests.OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def journal_stream(events: DataFrame, limits: requests.Limits = requests.Limits(), forget: bool = False) -> DataFrame:
    """The outcome of each event, as requests.replay_journal() gives it, over map states of each repository. Needs the RocksDB state store.

    forget: old answers leave the state, too, by a time to live. That takes triggers in processing time, so a stream that
    is to end with its input (availableNow) goes without.
    """
    rows = events.select(*requests.EVENT_COLUMNS)
    return rows.groupBy("repo").transformWithStateInPandas(JournalProcessor(limits, forget), requests.OUTCOME, "Append", "ProcessingTime" if forget else "None")


def provisional_timeouts(events: DataFrame, hours: int = 24) -> DataFrame:
    """(repository_id, expired_at) of repositories (repository_id, status, at) still provisional that long after their
    event, once the watermark has passed that."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due = state.get[0]
            state.remove()
            yield pd.DataFrame({"repository_id": [key[0]], "expired_at": [pd.Timestamp(due, unit="ms")]})
            return
        last = pd.concat(list(batches)).sort_values("at").iloc[-1]
        if last["status"] == "provisioning":
            due = int(pd.Timestamp(last["at"]).timestamp() * 1000) + hours * 3_600_000
            state.update((due,))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    timed = events.withWatermark("at", "0 seconds")
    return timed.groupBy("repository_id").applyInPandasWithState(fold, "repository_id long, expired_at timestamp", "due long", "append", GroupStateTimeout.EventTimeTimeout)


def work_items(events: DataFrame, path: str, checkpoint: str, key: str = "repo") -> None:
    """One work item a repository and trigger, however many events it had."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(key).distinct().withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_stream(objects: DataFrame, path: str, checkpoint: str, keys: list[str], value: str) -> None:
    """Appends the objects of each trigger that the table at path lacks; a trigger that is run again adds nothing."""
    from ..sources.readers import append_objects

    def write(batch: DataFrame, number: int) -> None:
        append_objects(batch, path, keys, value)

    objects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
