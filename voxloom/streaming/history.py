"""Structured Streaming jobs: loss history by timestep, running metrics, early stopping, and tile ingest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Keyed state lives on disk, beyond the executors' heap.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Ordered(StatefulProcessor):
    """Rows of a key folded in the order of an integer from 0 on, however they arrive; its event time is one second later than its number.

    Folded state is one value; what the watermark has not passed yet waits in a map by that integer, and a timer on event time folds it
    once nothing before it can come any more. Subclasses say how a row changes what waits and how that is folded.
    """

    state_type = waiting_type = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", self.state_type)
        self.waiting = handle.getMapState("waiting", "at long", self.waiting_type)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = {k[0]: v for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        state, changed = self.folded.get() if self.folded.exists() else self.start, set()
        for frame in rows:
            for row in frame.itertuples(index=False):
                state, changed = self.add(state, waiting, row), changed | {self.at(row)}
        self.folded.update(state)
        for at in changed:
            self.waiting.updateValue((at,), waiting[at])
        self.handle.registerTimer((max(changed) + 1) * 1000)
        yield self.result(key, reduce(self.fold, sorted(waiting.items()), state))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        ready = sorted((k[0], v) for k, v in self.waiting.iterator() if k[0] + 1 <= passed)
        self.folded.update(reduce(self.fold, ready, self.folded.get()))
        for at, _ in ready:
            self.waiting.removeKey((at,))
        yield from ()

    def close(self) -> None:
        pass


class _History(_Ordered):
    """The last row of each batch moves a timestep's average of squares; folded: rows seen, average."""

    state_type, waiting_type, start = "n long, average double", "pos long, loss double", (0, 0.0)

    def at(self, row) -> int:
        return int(row.batch_id)

    def add(self, state: tuple, waiting: dict, row) -> tuple:
        pos, _ = waiting.get(int(row.batch_id), (-1, 0.0))
        if row.pos >= pos:
            waiting[int(row.batch_id)] = (int(row.pos), float(row.loss))
        return state[0] + 1, state[1]

    def fold(self, state: tuple, item: tuple) -> tuple:
        return state[0], 0.9 * state[1] + 0.1 * item[1][1] ** 2

    def result(self, key: tuple, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({"t_index": [key[0]], "n": [state[0]], "loss_sq": [state[1]]})


def loss_history(events: DataFrame, late: int = 1000) -> DataFrame:
    """A stream of ``batch_id, pos, t_index, loss`` as running ``t_index, n, loss_sq``, in update mode; a timestep's row with the largest n is its last.

    Batches may arrive in any order and in parts as long as they are at most ``late`` batches behind the newest one; later
    ones are dropped. State is one row per timestep, and one for each of its batches that others may still precede.
    """
    timed = events.withColumn("at", F.timestamp_seconds(F.col("batch_id") + 1)).withWatermark("at", f"{late} seconds")
    return timed.groupBy("t_index").transformWithStateInPandas(_History(), "t_index int, n long, loss_sq double", "Update", "EventTime")


def running_metrics(stream: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Counts and means of a metric stream by tumbling window; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "metric").agg(F.count("*").alias("n"), F.avg("value").alias("value")).select(F.col("w.start").alias("start"), "metric", "n", "value")


class _Stops(StatefulProcessor):
    """The runs of one bucket; each run's values are folded in order of steps, a step of all runs at a time.

    State is two tables in one value, so that a batch reads and writes a bucket's state once and not once a run: what the watermark has
    passed, folded (rows seen, best value, steps without a better one, where it stopped (-1: not yet), whether there is any), and
    what waits by run and step. A timer on event time folds what nothing can precede any more.
    """

    def __init__(self, patience: int, min_delta: float) -> None:
        self.patience, self.min_delta = patience, min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "folded binary, waiting binary")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if self.state.exists():
            folded, waiting = (pa.ipc.open_stream(b).read_all().to_pandas() for b in self.state.get())
            return folded.set_index("run"), waiting
        folded = pd.DataFrame({"run": np.array([], "i8"), "n": np.array([], "i8"), "best": np.array([], "f8"), "wait": np.array([], "i8"), "stop": np.array([], "i8"), "any": np.array([], bool)})
        return folded.set_index("run"), pd.DataFrame({"run": np.array([], "i8"), "step": np.array([], "i8"), "value": np.array([], "f8")})

    def _store(self, folded: pd.DataFrame, waiting: pd.DataFrame) -> None:
        packed = []
        for table in (folded.reset_index(), waiting):
            out, rows = pa.BufferOutputStream(), pa.Table.from_pandas(table, preserve_index=False)
            with pa.ipc.new_stream(out, rows.schema) as writer:
                writer.write_table(rows)
            packed.append(out.getvalue().to_pybytes())
        self.state.update(tuple(packed))

    def _fold(self, folded: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """``folded`` moved on by rows of its runs: the first step of every run, then every second one, and so on."""
        out = folded.copy()
        at = out.index.get_indexer(rows["run"])
        order = np.lexsort((rows["step"].to_numpy(), at))
        at, step, value = at[order], rows["step"].to_numpy()[order], rows["value"].to_numpy()[order]
        first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1, [len(at)]]).astype(int)
        sizes = np.diff(first)
        longest = np.argsort(-sizes, kind="stable")  # runs that still have a step come first
        begin, left = first[:-1][longest], sizes[longest]
        best, wait, stop, any_ = (out[c].to_numpy(copy=True) for c in ("best", "wait", "stop", "any"))
        for k in range(int(left[0]) if len(at) else 0):
            i = begin[: np.searchsorted(-left, -k)] + k
            r = at[i]
            going = stop[r] < 0
            i, r = i[going], r[going]
            better = ~any_[r] | (value[i] - best[r] > self.min_delta)
            best[r] = np.where(better, value[i], best[r])
            wait[r] = np.where(better, 0, wait[r] + 1)
            stop[r] = np.where(~better & (wait[r] >= self.patience), step[i], stop[r])
            any_[r] = True
        return out.assign(best=best, wait=wait, stop=stop, any=any_)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        folded, waiting = self._load()
        new = pd.concat([f[["run", "step", "value"]] for f in rows]).astype({"run": "i8", "step": "i8", "value": "f8"})
        seen = new.groupby("run").size()
        fresh = seen.index.difference(folded.index)
        start = pd.DataFrame({"n": 0, "best": 0.0, "wait": 0, "stop": -1, "any": False}, index=fresh.rename("run"))
        folded = pd.concat([folded, start]) if len(folded) else start
        folded.loc[seen.index, "n"] += seen
        waiting = pd.concat([waiting, new]).drop_duplicates(["run", "step"], keep="last")
        self._store(folded, waiting)
        self.handle.registerTimer((int(new["step"].max()) + 1) * 1000)
        found = self._fold(folded.loc[seen.index], waiting[waiting["run"].isin(seen.index)]).reset_index()
        stop = found["stop"].astype("Int64").where(found["stop"] >= 0)
        yield pd.DataFrame({"run": found["run"].astype("int64"), "n": found["n"].astype("int64"), "stop_step": stop, "best": found["best"]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        folded, waiting = self._load()
        ready = waiting["step"] + 1 <= timerValues.getCurrentWatermarkInMs() // 1000
        if ready.any():
            self._store(self._fold(folded, waiting[ready]), waiting[~ready])
        yield from ()


def early_stops(metrics: DataFrame, patience: int, min_delta: float, late: int = 1000, buckets: int = 1024) -> DataFrame:
    """A stream of ``run, step, value`` as ``run, n, stop_step, best`` in update mode; n counts rows, stop_step is NULL while a run goes on.

    Steps may arrive in any order as long as they are at most ``late`` behind the newest one of all runs; later ones are dropped. An
    earlier step can still move a stop, so a run's row with the largest n counts. Runs are dealt to so many buckets, whose state is held together.
    """
    timed = metrics.withColumn("at", F.timestamp_seconds(F.col("step") + 1)).withWatermark("at", f"{late} seconds")
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Stops(patience, min_delta), "run long, n long, stop_step long, best double", "Update", "EventTime")


def new_tiles(spark: SparkSession, folder: str, schema, epochs: int = 1, options: dict[str, str] | None = None) -> DataFrame:
    """A file stream over a tile store; repetition is a column, not an endless source."""
    tiles = spark.readStream.schema(schema).options(**(options or {})).parquet(folder)
    return tiles.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def ingest(tiles: DataFrame, folder: str, keys: Sequence[str], time: str, late: str = "7 days") -> DataFrame:
    """Run a stream of tiles over all that its source holds now into a store that holds each tile once; gives the store.

    A tile sent again is told by ``keys`` (and its epoch) as long as its ``time`` is at most ``late`` behind the newest one;
    state for older ones is dropped, and so are they. Every micro-batch overwrites the folder named by its number, so that one
    that is repeated after a failure leaves its rows once.
    """
    once = tiles.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, "epoch"])
    return run_to_end(once, folder, "append", numbered=True)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append", numbered: bool = False) -> DataFrame:
    """Run a stream over all that its source holds now, and give what it wrote. Update and complete mode, and ``numbered`` ones, keep each
    micro-batch's rows apart by ``epoch_id``."""
    spark = stream.sparkSession
    for name, value in STORE.items():
        spark.conf.set(name, value)
    out, check = f"{folder}/out", f"{folder}/checkpoint"
    if mode == "append" and not numbered:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, k: df.withColumn("epoch_id", F.lit(k)).write.mode("overwrite").parquet(f"{out}/batch={k}")).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("epoch_id", "long")).parquet(f"{out}/batch=*") if mode != "append" or numbered else spark.read.parquet(out)
