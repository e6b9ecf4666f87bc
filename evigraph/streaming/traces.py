"""Streams of spans with state: routes of whole traces, and tables that are still known."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evigraph.functions import text
from evigraph.operators import traces

DAY_MS = 86_400_000


def route_observations(spans: DataFrame, gateways: list[str], services: list[str] | None = None, gap: str = "30 minutes", late: str = "10 minutes", every: str = "1 day", operation: str = traces.OPERATION) -> DataFrame:
    """STR-01 on a stream: window_end, and the columns of the batch operator, in append mode.

    Two stateful operators in a chain: a session window assembles each trace, and is closed once the watermark is `gap` past its last
    span; closed traces are summed up by the window in which they closed and by route. Spans behind the watermark are dropped.
    The same span may come several times."""
    f = traces.facts(spans, operation).withWatermark("start_ts", late)
    t = f.groupBy(F.session_window("start_ts", gap).alias("s"), "trace_id").agg(F.array_sort(F.collect_set(F.struct("start_ts", "span_id", "parent_id", "service", "path", "method", "route", "items"))).alias("spans"))
    ids = F.transform("spans", lambda s: s["span_id"])
    own = F.filter("spans", lambda s: s["service"].isin(*gateways) & s["path"].isNotNull())
    t = t.select("s", "trace_id", "spans", ids.alias("ids"), own.alias("own"))
    free = F.filter("own", lambda s: ~F.coalesce(F.array_contains("ids", s["parent_id"]), F.lit(False)))
    t = t.withColumn("root", F.coalesce(F.get(free, F.lit(0)), F.get("own", F.lit(0)))).where("root is not null")
    t = t.withColumns({"root_path": text.strip_query(F.col("root.path")), "method": F.col("root.method")})
    t = t.where((F.col("root_path") != "") & ~F.col("root_path").rlike(traces.NOISE))
    heard = F.col("spans") if not services else F.filter("spans", lambda s: s["service"].isin(*services, *gateways))
    t = t.withColumn("heard", heard)
    longer = F.filter("heard", lambda s: traces.below(s["route"], F.col("root_path")))
    best = F.get(F.array_sort(F.transform(longer, lambda s: F.struct((-F.length(s["route"])).alias("n"), s["start_ts"], s["span_id"], s["route"].alias("route")))), F.lit(0))
    found = F.flatten(F.transform("heard", lambda s: F.transform(s["items"], lambda i: F.struct(i["kind"].alias("kind"), i["item"].alias("item"), i["op"].alias("op"), F.struct(s["start_ts"].alias("start_ts"), s["span_id"].alias("span_id")).alias("at")))))
    t = t.select("s", "trace_id", "method", F.coalesce(best["route"], F.col("root_path")).alias("path"), F.array_max(F.transform("heard", lambda s: s["start_ts"])).alias("last_seen"), found.alias("found"))
    keys = F.array_distinct(F.transform("found", lambda i: F.struct(i["kind"].alias("kind"), i["item"].alias("item"))))

    def last_named(key: Column) -> Column:
        named = F.filter("found", lambda i: (i["kind"] == key["kind"]) & (i["item"] == key["item"]) & i["op"].isNotNull())
        last = F.get(named, F.size(named) - 1)
        return F.struct(key["kind"].alias("kind"), key["item"].alias("item"), last["op"].alias("op"), last["at"].alias("at"))

    whole = F.array(F.struct(F.lit("route").alias("kind"), F.lit("").alias("item"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("struct<start_ts:timestamp,span_id:bigint>").alias("at")))
    rows = t.select(F.window_time("s").alias("closed"), "trace_id", "method", "path", "last_seen", F.explode(F.concat(whole, F.transform(keys, last_named))).alias("i")).select("*", "i.*")
    out = traces.by_route(rows.withColumn("w", F.window("closed", every)), "w")
    return out.select(F.col("w.end").alias("window_end"), "method", "path", "kind", "item", "operation", "traces", "last_seen", "sample")


#: Tables share this many states: a call to a state serves thousands of tables, and one state is small enough to be held.
BUCKETS = 1024
KNOWN = ["table_name", "run_us", "hits", "last_us"]


class LastKnown(StatefulProcessor):
    """Per bucket of tables what each was last seen with; a timer at the end of each run without it carries it on as stale, and clears it beyond the limit.

    The state is one value a bucket, its rows as Arrow; runs are told with arrays, not table by table."""

    def __init__(self, run_ms: int, ttl_ms: int) -> None:
        self.run_us, self.ttl_us = run_ms * 1000, ttl_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))[KNOWN].assign(new=True)
        old = self._load()
        both = (pd.concat([old.assign(new=False), came]) if len(old) else came).sort_values(["table_name", "run_us"], kind="stable", ignore_index=True)
        later = both["table_name"].eq(both["table_name"].shift(-1)).to_numpy()
        following = both["run_us"].shift(-1, fill_value=0).to_numpy()
        # runs between are over; what comes after a table's last run is the timer's
        carried, _ = self._carried(both[later], following[later] - self.run_us)
        yield from self._told([carried, self._fresh(both[both["new"]])])
        self._keep(both.loc[~later, KNOWN])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._load()
        carried, left = self._carried(known, np.full(len(known), timerValues.getCurrentWatermarkInMs() * 1000))
        yield from self._told([carried])
        self._keep(left)

    def _fresh(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[KNOWN].assign(state="fresh")

    def _carried(self, rows: pd.DataFrame, until: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The runs after each row's up to `until`, while there is something to carry; and the rows as they are known then."""
        run, last = rows["run_us"].to_numpy("int64"), rows["last_us"].to_numpy("int64")
        end = (last + self.ttl_us - run) // self.run_us + 1  # the run, counted from this one, that is the first beyond the limit
        n = np.clip(np.minimum(end, (until - run) // self.run_us), 0, None)
        at = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1
        out = rows[KNOWN].iloc[at].assign(run_us=run[at] + step * self.run_us, state=np.where(step < end[at], "stale", "decayed"))
        return out, rows[KNOWN].assign(run_us=run + n * self.run_us)[n < end]

    def _load(self) -> pd.DataFrame:
        if not self.known.exists():
            return pd.DataFrame({"table_name": [], "run_us": np.array([], "int64"), "hits": np.array([], "int64"), "last_us": np.array([], "int64")})
        return pa.ipc.open_stream(self.known.get()[0]).read_pandas()

    def _keep(self, rows: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not len(rows):
            self.known.clear()
            return
        table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        self.known.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(rows["run_us"].min()) // 1000 + self.run_us // 1000)

    def _told(self, parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts)
        for k in range(0, len(rows), 50_000):
            r = rows.iloc[k : k + 50_000]
            at = lambda c: pd.to_datetime(r[c].to_numpy(), unit="us", utc=True)  # noqa: B023, E731
            yield pd.DataFrame({"table_name": r["table_name"].to_numpy(), "run": at("run_us"), "hits": r["hits"].to_numpy(), "last_seen": at("last_us"), "state": r["state"].to_numpy()})

    def close(self) -> None:
        pass


def carried_runs(hits: DataFrame, late: str = "10 minutes", run_days: int = 1, ttl_days: int = 7) -> DataFrame:
    """STR-03 on a stream of table hits (table_name, start_ts): the rows of the batch operator, up to the run that the watermark has passed.

    A window by run and table, then state by bucket of tables with event-time timers; needs the RocksDB state store (with_rocksdb)."""
    runs = traces.observed_runs(hits.withWatermark("start_ts", late), f"{run_days} day")
    bucket = F.pmod(F.xxhash64("table_name"), F.lit(BUCKETS)).cast("int").alias("bucket")
    runs = runs.select(bucket, "table_name", F.unix_micros("run").alias("run_us"), "hits", F.unix_micros("last_seen").alias("last_us"))
    keep = LastKnown(run_days * DAY_MS, ttl_days * DAY_MS)
    return runs.groupBy("bucket").transformWithStateInPandas(keep, "table_name string, run timestamp, hits long, last_seen timestamp, state string", "Append", "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(result: DataFrame, folder: str) -> DataFrame:
    """Runs an append stream over what is there; started again on the same folder it goes on where it ended. Rows are written once each.

    Not by an available-now trigger: for sources of one's own that ends without the last batch, in which the watermark closes windows."""
    query = result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/out")
