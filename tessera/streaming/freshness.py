"""Refreshing what has changed: quiet files as session windows, and batches of them as a stateful processor with timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.tables import SOURCE_EXTENSIONS

# Folders whose changes are not watched.
UNWATCHED = (".brain", ".atlas", ".git", "dist", "node_modules", ".next", ".turbo", ".cache", "coverage", "build", "out", ".vercel")

#: Changes in one value of the state, at most.
BLOCK = 50_000

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watched(changes: DataFrame) -> DataFrame:
    """The changes of source files outside the folders that are not watched; null paths and paths that climb out are none."""
    parts = F.split("file_path", "/")
    inside = ~F.arrays_overlap(parts, F.array(*map(F.lit, UNWATCHED))) & ~F.col("file_path").rlike(r"^(/|\.\.(/|$))")
    return changes.where(inside & F.lower(F.regexp_extract("file_path", r"[^/]\.(\w+)$", 1)).isin(*SOURCE_EXTENSIONS))


def quiet_changes(changes: DataFrame, *, keys: tuple[str, ...] = ("workspace", "file_path"), at: str = "at", quiet: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """(keys, due_at, changes, id, kind): a file falls due once nothing has touched it for ``quiet``; of its changes the last is shown.

    ``id`` settles ties of time. A row is given once, when the watermark has passed its due time; then its state goes.
    """
    of_file = changes.withWatermark(at, late).groupBy(F.session_window(at, quiet).alias("w"), *keys)
    out = of_file.agg(F.count("*").alias("changes"), F.max_by(F.struct("id", "kind"), F.struct(at, "id")).alias("last"))
    return out.select(*keys, F.col("w.end").alias("due_at"), "changes", "last.*")


def _block(ms: np.ndarray, paths: pa.Array) -> bytes:
    """Changes as one value of the state; each path is held once."""
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), paths.dictionary_encode()], names=["ms", "file_path"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _in_order(blocks: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The times of all changes of the blocks and the numbers of their paths, by time and path, and the paths by number."""
    tables = [pa.ipc.open_stream(b).read_all() for b in blocks]
    if not tables:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    every = pa.concat_tables(tables).unify_dictionaries().combine_chunks()
    ms, paths = every.column(0).to_numpy(), every.column(1).chunk(0)
    names = paths.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    number = rank[paths.indices.to_numpy()]
    by = np.lexsort((number, ms))
    return ms[by], number[by], [names[i] for i in order]


class _Refresher(StatefulProcessor):
    """Of one workspace: changes that the watermark has not passed, files that wait, and when the timer is due.

    Changes are kept in blocks of up to BLOCK, as each value of the state costs a call to it.
    """

    def __init__(self, debounce: int, cooldown: int, most: int):
        self.debounce, self.cooldown, self.most = debounce, cooldown, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getListState("coming", "changes binary")
        self.pending = handle.getMapState("pending", "file_path string", "place long")
        self.clock = handle.getValueState("clock", "due long, started long, batches long, places long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.coming.appendValue((_block(frame["ms"].to_numpy(np.int64), pa.array(frame["file_path"], pa.string())),))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, until: int) -> Iterator[pd.DataFrame]:
        """Plays what lies before the watermark, in order of time and path, and sets the timer to what comes next."""
        due, started, batches, places = self.clock.get() if self.clock.exists() else (None, None, 0, 0)
        ms, number, names = _in_order(bytes(b) for (b,) in self.coming.get())
        ready = int(np.searchsorted(ms, until))
        waits = {path: place for (path,), (place,) in self.pending.iterator()}
        before, given = dict(waits), []
        played = (zip(ms[i : min(i + BLOCK, ready)].tolist(), number[i : min(i + BLOCK, ready)].tolist()) for i in range(0, ready, BLOCK))
        for now, n in chain(chain.from_iterable(played), [(until, None)]):
            while due is not None and (due <= now if n is not None else due < now):
                if started is not None and due - started < self.cooldown:
                    due = started + self.cooldown
                    continue
                files = sorted(waits, key=waits.get)[: self.most]
                given.append((batches, due, files))
                for f in files:
                    del waits[f]
                started, batches = due, batches + 1
                due = due + self.cooldown if waits else None
            if n is not None:
                path = names[n]
                if path not in waits:
                    waits[path], places = places, places + 1
                due = now + self.debounce
        for path in before.keys() - waits.keys():
            self.pending.removeKey((path,))
        for path, place in waits.items():
            if before.get(path) != place:
                self.pending.updateValue((path,), (place,))
        self.clock.update((due, started, batches, places))
        if ready:
            self.coming.clear()
            for i in range(ready, len(ms), BLOCK):
                self.coming.appendValue((_block(ms[i : i + BLOCK], pa.array(names, pa.string()).take(pa.array(number[i : i + BLOCK]))),))
        self._arm(min(ms[ready : ready + 1].tolist() + [due] * (due is not None), default=None))
        if given:
            numbers, times, files = zip(*given)
            yield pd.DataFrame({"workspace": [key[0]] * len(given), "batch": numbers, "started_at": pd.to_datetime(times, unit="ms"), "files": files})

    def _arm(self, at: int | None) -> None:
        armed = list(self.handle.listTimers())
        for t in armed:
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None and at not in armed:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def refresh_batches(changes: DataFrame, *, at: str = "at", debounce_ms: int = 1_500, cooldown_ms: int = 15_000, most: int = 20, late: str = "10 minutes") -> DataFrame:
    """(workspace, batch, started_at, files): the batches of files to read again, from a stream of (workspace, file_path, ``at``).

    A change makes its file wait, in the order of first change, and puts the workspace's timer off to ``debounce_ms`` later.
    When it runs out, the first ``most`` files that wait are a batch, unless the last batch started less than ``cooldown_ms``
    before: then the timer is due at the end of that time. Files that still wait are due ``cooldown_ms`` after the batch.
    A timer due at the time of a change runs first; changes at one time are taken by path. Reading again takes no event time.

    Time is event time: a batch is given once the watermark has passed its start, so it doesn't depend on how changes fall into
    micro-batches, and changes later than the watermark are left out. State, kept in RocksDB, is blocks of the changes that
    the watermark has not passed and a row for each file that waits. Changes without a time or a workspace are left out.
    """
    own = watched(changes).where(F.col(at).isNotNull() & F.col("workspace").isNotNull()).select("workspace", "file_path", at)
    # the watermark has whole milliseconds
    own = own.withWatermark(at, late).withColumn("ms", F.unix_millis(at))
    return own.groupBy("workspace").transformWithStateInPandas(
        _Refresher(debounce_ms, cooldown_ms, most), "workspace string, batch long, started_at timestamp, files array<string>", "append", "EventTime"
    )


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which processors with timers need."""
    name, provider = ROCKSDB
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
