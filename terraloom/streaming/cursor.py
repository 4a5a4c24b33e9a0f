"""Streams that are looked up by time in one forward pass: the samples before and after each asked time, from kept state.

Each key keeps its last sample and the asked times that still wait for the next one, and nothing else; keys are kept in
groups, as each call for state costs the same for one key as for many. Time must not go back
from one batch to the next; within a batch rows are put in order first. State is in the checkpoint, so a restarted stream
goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from terraloom.operators.storage import shared_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = -(1 << 62)


#: Groups of keys: a group's state is read and written as two lists, so the calls for state don't grow with the keys.
GROUPS = 1024


class Between(StatefulProcessor):
    """Rows (key, t, asked, id, values) of a group of keys -> key, id, t and the samples before and after, once the later one is there."""

    def __init__(self, key: str, values: list[str]) -> None:
        self.key, self.values = key, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = ", ".join(f"v{i} double" for i in range(len(self.values)))
        self.last = handle.getListState("last", ", ".join(["key string, seen long, t long, id long", numbers] if numbers else ["key string, seen long, t long, id long"]))
        self.waiting = handle.getListState("waiting", "key string, t long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [f"v{i}" for i in range(len(self.values))]
        got = pd.concat(list(rows), ignore_index=True)[[self.key, "t", "asked", "id", *self.values]]
        got.columns = ["key", "t", "asked", "id", *held]
        got["fresh"] = True
        last = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        keys = {k: i for i, k in enumerate(dict.fromkeys([*(r[0] for r in last), *(None if k is None or k != k else k for k in got["key"])]))}
        names, here = list(keys), np.array([keys[None if k is None or k != k else k] for k in got["key"]], np.int64)
        seen, first = np.full(len(names), NONE), np.full(len(names), np.iinfo(np.int64).max)
        seen[[keys[r[0]] for r in last]] = [r[1] for r in last]
        np.minimum.at(first, here, got["t"].to_numpy())
        if (first < seen).any():
            i = int(np.argmax(first < seen))
            raise ValueError(f"time goes back for {names[i]}: from {seen[i]} to {first[i]}")
        np.maximum.at(seen, here, got["t"].to_numpy())
        # what is kept comes with what is new: samples before asked times of one moment, and of equal samples the largest id first
        columns = ["k", "t", "asked", "id", *held, "fresh"]
        kept = [(keys[r[0]], r[2], False, r[3], *r[4:], False) for r in last if r[2] != NONE]
        kept += [(keys[k], t, True, i, *([np.nan] * len(held)), False) for k, t, i in waiting]
        parts = [got.assign(k=here)[columns], pd.DataFrame(kept, columns=columns)] if kept else [got.assign(k=here)[columns]]
        both = pd.concat(parts, ignore_index=True)
        k, t, asked, id_ = (both[c].to_numpy(kind) for c, kind in (("k", np.int64), ("t", np.int64), ("asked", bool), ("id", np.int64)))
        order = np.lexsort((np.where(asked, id_, -id_), both["fresh"].to_numpy(bool), asked, t, k))
        k, t, asked, id_, v = k[order], t[order], asked[order], id_[order], both[held].to_numpy(float).reshape(len(both), len(held))[order]
        # of samples of one time the first one counts
        sample = ~asked
        sample[1:] &= ~(~asked[:-1] & (k[1:] == k[:-1]) & (t[1:] == t[:-1]))
        at = np.flatnonzero(sample)
        ask = np.flatnonzero(asked)
        nth = np.searchsorted(at, ask) - 1  # the sample before, or at the very time
        before = np.where((nth >= 0) & (k[at[nth]] == k[ask]), at[nth], -1) if len(at) else np.full(len(ask), -1)
        nxt = nth + 1
        after = np.where((nxt < len(at)) & (k[at[np.minimum(nxt, len(at) - 1)]] == k[ask]), at[np.minimum(nxt, len(at) - 1)], -1) if len(at) else np.full(len(ask), -1)
        after = np.where((before >= 0) & (t[before] == t[ask]), before, after)
        done = after >= 0
        self._keep(names, seen, k, t, id_, v, at, ask[~done])
        if done.any():
            yield self._frame(names, k, t, id_, v, ask[done], before[done], after[done])

    def _keep(self, names: list, seen: np.ndarray, k: np.ndarray, t: np.ndarray, id_: np.ndarray, v: np.ndarray, at: np.ndarray, open_: np.ndarray) -> None:
        """Writes each key's last sample and the asked times that wait."""
        newest = np.full(len(names), -1)
        newest[k[at]] = at  # the last of each key: they are in order of time
        none = (NONE, NONE, *([np.nan] * v.shape[1]))
        self.last.put([(n, int(s), *((int(t[i]), int(id_[i]), *map(float, v[i])) if i >= 0 else none)) for n, s, i in zip(names, seen, newest.tolist(), strict=True)])
        if len(open_):
            self.waiting.put([(names[k[i]], int(t[i]), int(id_[i])) for i in open_.tolist()])
        else:
            self.waiting.clear()

    def _frame(self, names: list, k: np.ndarray, t: np.ndarray, id_: np.ndarray, v: np.ndarray, ask: np.ndarray, before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
        none = before < 0
        whole = lambda x, missing=False: pd.arrays.IntegerArray(x, (x == NONE) | missing)
        frame = {self.key: [names[i] for i in k[ask].tolist()], "id": whole(id_[ask]), "t": t[ask], "before": whole(id_[before], none), "before_t": whole(t[before], none), "after": whole(id_[after]), "after_t": t[after]}
        for side, x in (("before", np.where(none[:, None], np.nan, v[before])), ("after", v[after])):
            frame |= {f"{side}_{name}": x[:, i] for i, name in enumerate(self.values)}
        return pd.DataFrame(frame)

    def close(self) -> None:
        pass


def between(stream: DataFrame, key: str, values: list[str]) -> DataFrame:
    """stream(key, t long, asked boolean, id long, values double) -> key (as text), id, t, before, before_t, after, after_t, before_ and after_ values.

    A row for each asked time once a sample at or after it has come: the last sample up to it (null if none) and the first
    from it on; a sample at the very time is both. Asked times after the last sample wait in the state. Of samples of one
    time the largest id counts. Raises if a later batch has an earlier time. Null keys are a key; rows of null time are left out.
    Keys go in GROUPS groups by their hash: a batch rewrites the state of the groups that it has rows of.
    """
    longs = [StructField(c, LongType()) for c in ("id", "t", "before", "before_t", "after", "after_t")]
    doubles = [StructField(f"{side}_{v}", DoubleType()) for side in ("before", "after") for v in values]
    rows = stream.filter(F.col("t").isNotNull()).select(F.col(key).cast("string").alias(key), "t", "asked", F.coalesce("id", F.lit(NONE)).alias("id"), *(F.col(v).cast("double").alias(v) for v in values))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    return rows.groupBy("_group").transformWithStateInPandas(Between(key, values), outputStructType=StructType([StructField(key, StringType()), *longs, *doubles]), outputMode="append", timeMode="none")


def interpolated(found: DataFrame, values: list[str]) -> DataFrame:
    """The result of between() with each value drawn linearly between its two samples; rows without an earlier sample are left out: nothing is extrapolated."""
    share = F.when(F.col("after_t") > F.col("before_t"), (F.col("t") - F.col("before_t")) / (F.col("after_t") - F.col("before_t"))).otherwise(0.0)
    at = {v: F.col(f"before_{v}") + share * (F.col(f"after_{v}") - F.col(f"before_{v}")) for v in values}
    return found.filter(F.col("before").isNotNull()).select(found.columns[0], "id", "t", *(x.alias(v) for v, x in at.items()))


def run_forward(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Runs such a stream over all that is there and returns what it has written; a path given again goes on from its checkpoint."""
    spark = stream.sparkSession
    at = at or shared_path(spark, name)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the only store that keeps lists and values by name
    try:
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/result").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def between_batch(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """What between() gives for a bounded table, by windows: for tests and for history."""
    rows = rows.filter(F.col("t").isNotNull()).withColumn(key, F.col(key).cast("string"))
    kept = F.struct("t", "id", *(F.col(v).cast("double").alias(v) for v in values))
    sample = rows.filter("NOT asked").groupBy(key, "t").agg(F.max(kept).alias("s")).withColumns({"asked": F.lit(False), "id": F.lit(None).cast("long")})
    both = rows.filter("asked").select(key, "t", "asked", "id").withColumn("s", F.lit(None).cast(sample.schema["s"].dataType)).unionByName(sample)
    back = Window.partitionBy(key).orderBy("t", F.col("asked")).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(key).orderBy("t", F.col("asked").desc()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumns({"b": F.last("s", ignorenulls=True).over(back), "a": F.first("s", ignorenulls=True).over(on)}).filter("asked AND a IS NOT NULL")
    columns = [F.col("b.id").alias("before"), F.col("b.t").alias("before_t"), F.col("a.id").alias("after"), F.col("a.t").alias("after_t")]
    return found.select(key, "id", "t", *columns, *(F.col(f"{s[0]}.{v}").alias(f"{s}_{v}") for s in ("before", "after") for v in values))
