"""Traces: the rules of the root, the route and the items, the data source and its second attempt, and streams against batches."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evigraph.operators import traces
from evigraph.sources.shared import scratch
from evigraph.sources.traces import TraceSource, spans_of, write_traces
from evigraph.streaming import traces as streams

T0 = datetime(2024, 3, 1, 8)
SPAN = "trace_id string, span_id long, parent_id long, service string, start_ts timestamp, tags map<string,string>"


def span(trace, n, parent=None, service="gw", at=0, **tags):
    return trace, n, parent, service, T0 + timedelta(minutes=at), {k.replace("_", "."): v for k, v in tags.items()}


#: a: a browser span outside of the trace above the gateway; the route of the backend; schema, quotes and case of tables
#: b: no span of the gateway; c: noise; d: another system's tables; e: only gateway spans with parents in the trace
TRACES = [
    span("a", 2, 99, at=0, url_path="/shop?x=1", http_method="post"),
    span("a", 3, 2, "app", 1, http_route="/shop/findItems.v1", db_sql_table="public.OrderLine", db_operation="select"),
    span("a", 4, 3, "app", 2, db_query_text="update `Order_Line` set x=1", db_operation_name="Update"),
    span("a", 5, 3, "app", 3, db_collection_name="order_line", page_route="/cart"),
    span("a", 6, 3, "gw", 4, url_path="/other"),
    span("b", 1, None, "app", 0, http_route="/shop/x.v1"),
    span("c", 1, None, "gw", 0, http_target="/health/live"),
    span("d", 1, None, "gw", 5, http_target="/shop"),
    span("d", 2, 1, "foreign", 6, http_route="/shop/foreignThing.v2", db_sql_table="secret"),
    span("d", 3, 1, "app", 6, http_route="/shopping/findAll.v1"),
    span("e", 1, 2, "gw", 7, http_route="/shop/a"),
    span("e", 2, 1, "gw", 8, http_route="/shop/b"),
]


def told(df):
    return {(r["method"], r["path"], r["kind"], r["item"]): (r["operation"], r["traces"], list(r["sample"])) for r in df.collect()}


WANT = {
    ("POST", "/shop/findItems.v1", "route", ""): (None, 1, ["a"]),
    ("POST", "/shop/findItems.v1", "table", "order_line"): ("UPDATE", 1, ["a"]),
    ("POST", "/shop/findItems.v1", "endpoint", "/shop/findItems.v1"): (None, 1, ["a"]),
    ("POST", "/shop/findItems.v1", "page", "/cart"): (None, 1, ["a"]),
    ("GET", "/shop", "route", ""): (None, 1, ["d"]),
    ("GET", "/shop", "endpoint", "/shopping/findAll.v1"): (None, 1, ["d"]),
    ("GET", "/shop/a", "route", ""): (None, 1, ["e"]),
}


def test_routes_of_traces(spark):
    df = spark.createDataFrame(TRACES, SPAN).repartition(3)
    assert told(traces.route_observations(df, ["gw"], ["app"])) == WANT
    heard = told(traces.route_observations(df, ["gw"]))
    assert ("GET", "/shop/foreignThing.v2", "table", "secret") in heard and ("GET", "/shop", "route", "") not in heard
    assert traces.route_observations(df.where("false"), ["gw"]).count() == 0


def test_at_most_five_traces_are_told(spark):
    df = spark.createDataFrame([span(f"t{i}", 1, None, "gw", i, url_path="/p") for i in range(200)], SPAN)
    (_, n, sample), = told(traces.route_observations(df, ["gw"])).values()
    assert n == 200 and len(sample) == 5 and sample == sorted(sample)


def json_stream(spark, folder, files):
    folder.mkdir(exist_ok=True)
    for name, rows in files.items():
        (folder / name).write_text("\n".join(json.dumps({"trace_id": r[0], "span_id": r[1], "parent_id": r[2], "service": r[3], "start_ts": r[4].isoformat(), "tags": r[5]}) for r in rows))
    return spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).json(str(folder))


def test_route_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    """Spans of a trace in two files; the second start goes on with the open traces of the first."""
    later = [span("z", 1, None, "gw", 60 * 24 * 4, url_path="/end")]
    first = json_stream(spark, tmp_path / "in", {"1.json": TRACES[:3]})
    run = lambda s: streams.drain(streams.route_observations(s, ["gw"], ["app"]), f"file://{tmp_path}/run")
    assert run(first).count() == 0
    second = json_stream(spark, tmp_path / "in", {"2.json": TRACES[2:], "3.json": later})
    out = run(second)
    assert told(out) == WANT and {r["window_end"] for r in out.collect()} == {datetime(2024, 3, 2)}


def test_late_spans_are_dropped(spark, tmp_path):
    """A span behind the watermark opens no trace: neither a new one, nor once more one that was closed."""
    files = {"1.json": TRACES, "2.json": [span("y", 1, None, "gw", 60 * 24 * 2, url_path="/y")], "3.json": [span("late", 1, None, "gw", 3, url_path="/late"), span("a", 9, None, "gw", 5, url_path="/again")], "4.json": [span("z", 1, None, "gw", 60 * 24 * 6, url_path="/end")]}
    rows = []
    for name, content in files.items():  # one file at a time, in this order
        out = streams.drain(streams.route_observations(json_stream(spark, tmp_path / "in", {name: content}), ["gw"], ["app"]), f"file://{tmp_path}/run")
        rows.append(told(out))
    assert rows[-1] == WANT | {("GET", "/y", "route", ""): (None, 1, ["y"])}


HIT = "table_name string, start_ts timestamp"


def hits(*rows):
    return [(t, T0 + timedelta(days=d)) for t, d in rows]


def batch_runs(spark, rows, horizon):
    o = traces.observed_runs(spark.createDataFrame(rows, HIT))
    return {tuple(r) for r in traces.carried_runs(o, F.lit(horizon)).collect()}


def test_runs_are_fresh_stale_and_decayed(spark):
    rows = hits(("a", 0), ("a", 0.1), ("a", 3), ("b", 0), ("c", 12))
    end = lambda d: datetime(2024, 3, 2) + timedelta(days=d)
    got = {(t, r): (h, s) for t, r, h, _, s in batch_runs(spark, rows, datetime(2024, 3, 12))}
    want = {("a", end(0)): (2, "fresh"), ("a", end(1)): (2, "stale"), ("a", end(2)): (2, "stale"), ("a", end(3)): (1, "fresh")}
    want |= {("a", end(3 + i)): (1, "stale") for i in range(1, 7)} | {("a", end(10)): (1, "decayed")}
    want |= {("b", end(0)): (1, "fresh"), ("b", end(7)): (1, "decayed")} | {("b", end(i)): (1, "stale") for i in range(1, 7)}
    assert got == want


def test_state_stream_equals_batch_over_two_runs(spark, tmp_path):
    """Two starts on one state: what the first one saw is carried, expires by its timer, and is fresh again where it comes again."""
    one, two = hits(("a", 0), ("b", 0.5), ("b", 2), ("a", 4)), hits(("a", 5), ("c", 6), ("b", 20), ("c", 23), ("d", 25))
    folder = tmp_path / "hits"
    folder.mkdir()

    def put(name, rows):
        (folder / name).write_text("\n".join(json.dumps({"table_name": t, "start_ts": at.isoformat()}) for t, at in rows))
        with streams.with_rocksdb(spark):
            stream = spark.readStream.schema(HIT).json(str(folder))
            out = streams.drain(streams.carried_runs(stream), f"file://{tmp_path}/runs")
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got))
        return set(got)

    assert put("1.json", one) == batch_runs(spark, one, datetime(2024, 3, 5))
    got = put("2.json", two)
    assert got == batch_runs(spark, one + two, datetime(2024, 3, 26))
    assert {r[4] for r in got} == {"fresh", "stale", "decayed"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def fetched(spark, path, **options):
    spark.dataSource.register(TraceSource)
    return spark.read.format("traces").options(path=path, services="gw,app,none", **options).load()


def test_trace_files_come_back_as_spans(spark):
    path = scratch(spark, "traces")
    write_traces(spark.createDataFrame(TRACES, SPAN), path)
    now = int((T0 + timedelta(hours=1)).timestamp())
    back = spans_of(fetched(spark, path, now=now, lookback_s=7200)).dropDuplicates(["trace_id", "span_id"]).collect()
    assert sorted((r["trace_id"], r["span_id"], r["parent_id"], r["service"], r["tags"]) for r in back) == sorted((t, n, p, s, g) for t, n, p, s, _, g in TRACES)
    assert fetched(spark, path, now=now, lookback_s=7200).select("service").distinct().count() == 2


@pytest.mark.parametrize("lookback,retried,ok,used", [(7200, False, True, 7200), (86_400, True, True, 43_200), (3 * 86_400, True, False, 129_600), (100, True, False, 60)])
def test_a_failed_request_is_made_again_over_half_of_the_window(spark, lookback, retried, ok, used):
    """An unreadable line 20 hours back fails windows that reach its bucket."""
    path = scratch(spark, "traces")
    write_traces(spark.createDataFrame([r for r in TRACES if r[0] != "c"], SPAN), path, bucket_s=3600)
    now = int((T0 + timedelta(hours=1)).timestamp())
    back = 20 * 3600 if lookback > 100 else 60
    spark.range(1).select(F.lit("{").alias("value"), F.lit("gw").alias("service"), F.lit((now - back) // 3600).alias("bucket")).write.mode("append").partitionBy("service", "bucket").text(path)
    report = {r["service"]: r for r in fetched(spark, path, now=now, lookback_s=lookback, bucket_s=3600, report="true").collect()}
    r = report["gw"]
    assert (r["retried"], r["ok"], r["lookback_s"]) == (retried, ok, used) and (r["error"] is None) == ok
    assert r["traces"] == (3 if ok else 0)
    assert report["none"]["ok"] and report["none"]["traces"] == 0 and not report["none"]["retried"]


def test_the_newest_traces_of_a_service_are_taken(spark):
    path = scratch(spark, "traces")
    write_traces(spark.createDataFrame([span(f"t{i:02}", 1, None, "gw", i, url_path="/p") for i in range(50)], SPAN), path)
    got = fetched(spark, path, now=int((T0 + timedelta(hours=1)).timestamp()), limit=7).collect()
    assert sorted(r["trace_id"] for r in got) == [f"t{i}" for i in range(43, 50)]


def test_the_newest_bucket_waits(spark, tmp_path):
    path = f"file://{tmp_path}/traces"
    spark.dataSource.register(TraceSource)
    stream = lambda **o: spark.readStream.format("traces").options(path=path, services="gw", **o).load().select("trace_id")
    write_traces(spark.createDataFrame([span("one", 1, None, "gw", 0), span("two", 1, None, "gw", 60 * 30)], SPAN), path)
    assert [r[0] for r in streams.drain(stream(), f"file://{tmp_path}/run").collect()] == ["one"]
    assert sorted(r[0] for r in streams.drain(stream(last="true"), f"file://{tmp_path}/run").collect()) == ["one", "two"]


def test_tables_share_states(spark, tmp_path):
    """A call to a state serves all tables of its bucket: with 3000 tables there are at most as many states as buckets."""
    rows = hits(*[(f"t{i}", d) for i in range(3000) for d in (0, i % 9 + 1)], ("z", 40))
    (tmp_path / "hits").mkdir()
    spark.createDataFrame(rows, HIT).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/hits")
    with streams.with_rocksdb(spark):
        out = streams.drain(streams.carried_runs(spark.readStream.schema(HIT).parquet(f"{tmp_path}/hits")), f"file://{tmp_path}/runs")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    assert {r for r in got if r[0] != "z"} == {r for r in batch_runs(spark, rows, datetime(2024, 4, 10)) if r[0] != "z"}
    assert streams.BUCKETS < 3000
