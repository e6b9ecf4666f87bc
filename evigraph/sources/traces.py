"""SRC-04: a data source of traces kept as files, by service and time, for batch and streaming reads.

`spark.dataSource.register(TraceSource)`, then `spark.read.format("traces")` or `spark.readStream.format("traces")`. The folder holds
`service=<name>/bucket=<n>/` with one JSON document a line: trace_id, last_us and spans; bucket n holds the traces whose last span
began in the n-th stretch of `bucket_s` seconds since 1970.

Options: path; services (comma-separated, one partition each); now (seconds since 1970); lookback_s; limit (newest traces of a service); bucket_s;
report = true (a row per service instead of traces); last = true (streams: also take the newest bucket, which may still grow).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TRACES = "trace_id string, service string, last_us long, body string"
REPORT = "service string, ok boolean, error string, traces long, retried boolean, lookback_s long"
SPAN = "span_id long, parent_id long, service string, start_us long, tags map<string,string>"
#: A day back, 400 traces a service; the window of the second attempt is half as long, a minute at least.
LOOKBACK_S, LIMIT, LEAST_S = 86_400, 400, 60


@dataclass
class Service(InputPartition):
    """What one task reads: a service up to a moment (microseconds), and in streams its buckets from `start` to before `end`."""

    name: str
    start: int = 0
    end: int = 0


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return REPORT if self.options.get("report") == "true" else TRACES

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TraceStream(dict(self.options))


class Folder:
    """The buckets of a service."""

    def __init__(self, options: dict) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.services = o["path"], [s for s in o["services"].split(",") if s]
        self.bucket_us = int(o.get("bucket_s", 86_400)) * 1_000_000
        self.lookback_s, self.limit = int(o.get("lookback_s", LOOKBACK_S)), int(o.get("limit", LIMIT))
        self.now_us = int(o["now"]) * 1_000_000 if "now" in o else None
        self.report, self.last = o.get("report") == "true", o.get("last") == "true"

    def buckets(self, service: str) -> list[tuple[int, str]]:
        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(f"{base}/service={service}", allow_not_found=True))
        return sorted((int(f.base_name.removeprefix("bucket=")), f.path) for f in found if f.base_name.startswith("bucket="))

    def newest(self) -> int:
        return max((b[-1][0] for s in self.services if (b := self.buckets(s))), default=-1)

    def lines(self, bucket: str) -> Iterator[str]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for f in system.get_file_info(fs.FileSelector(bucket)):
            if f.is_file and not f.base_name.startswith(("_", ".")):
                with system.open_input_stream(f.path) as stream:
                    left = b""
                    while chunk := stream.read(1 << 20):
                        *whole, left = (left + chunk).split(b"\n")
                        yield from (x.decode() for x in whole if x)
                    if left:
                        yield left.decode()

    def fetch(self, service: str, start_us: int, end_us: int) -> list[tuple]:
        """The newest `limit` traces that ended from start_us to before end_us. Any unreadable line of the window fails it as a whole."""
        kept: list[tuple] = []
        for n, bucket in self.buckets(service):
            if n * self.bucket_us < end_us and (n + 1) * self.bucket_us > start_us:
                for line in self.lines(bucket):
                    t = json.loads(line)
                    if start_us <= t["last_us"] < end_us:
                        kept.append((-t["last_us"], t["trace_id"], line))
                        if len(kept) >= 2 * self.limit:
                            kept = sorted(kept)[: self.limit]
        return [(trace, service, -last, line) for last, trace, line in sorted(kept)[: self.limit]]


class TraceReader(DataSourceReader):
    """A failed request is made once more, over half of the window; a second failure leaves the service without traces. Nothing is raised:
    the report tells what happened."""

    def __init__(self, options: dict) -> None:
        self.folder = Folder(options)

    def partitions(self) -> list[Service]:
        end = (self.folder.newest() + 1) * self.folder.bucket_us if self.folder.now_us is None else self.folder.now_us
        return [Service(s, end=end) for s in self.folder.services]

    def read(self, partition: Service) -> Iterator[tuple]:
        back, retried = self.folder.lookback_s, False
        rows, error = self._attempt(partition, back)
        if error is not None:
            retried, back = True, max(LEAST_S, back // 2)
            rows, error = self._attempt(partition, back)
        if self.folder.report:
            yield partition.name, error is None, error, len(rows), retried, back
        else:
            yield from rows

    def _attempt(self, partition: Service, back: int) -> tuple[list[tuple], str | None]:
        try:
            return self.folder.fetch(partition.name, partition.end - back * 1_000_000, partition.end), None
        except (OSError, ValueError, KeyError) as e:
            return [], type(e).__name__


class TraceStream(DataSourceStreamReader):
    """The offset is the first bucket not yet read. The newest bucket waits for a newer one, unless it is known to be the last."""

    def __init__(self, options: dict) -> None:
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"bucket": 0}

    def latestOffset(self) -> dict:
        return {"bucket": max(0, self.folder.newest() + self.folder.last)}

    def partitions(self, start: dict, end: dict) -> list[Service]:
        return [Service(s, start["bucket"], end["bucket"]) for s in self.folder.services] if end["bucket"] > start["bucket"] else []

    def read(self, partition: Service) -> Iterator[tuple]:
        for n, bucket in self.folder.buckets(partition.name):
            if partition.start <= n < partition.end:
                for line in self.folder.lines(bucket):
                    t = json.loads(line)
                    yield t["trace_id"], partition.name, t["last_us"], line

    def commit(self, end: dict) -> None:
        pass


def spans_of(traces: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_id, service, start_ts, tags of the traces' documents, batch or stream."""
    spans = F.from_json("body", f"spans array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in SPAN.split(', '))}>>")["spans"]
    s = traces.select("trace_id", F.explode(spans).alias("s"))
    return s.select("trace_id", "s.span_id", "s.parent_id", "s.service", F.timestamp_micros("s.start_us").alias("start_ts"), "s.tags")


def write_traces(spans: DataFrame, path: str, bucket_s: int = 86_400) -> None:
    """Spans (trace_id, span_id, parent_id, service, start_ts, tags) as trace files: a trace stands under each service that took part."""
    s = spans.withColumns({"start_us": F.unix_micros(F.col("start_ts").cast("timestamp")), "tags_json": F.to_json("tags")})
    t = s.groupBy("trace_id").agg(F.max("start_us").alias("last_us"), F.array_sort(F.collect_list(F.struct("start_us", "span_id", "parent_id", "service", "tags_json"))).alias("spans"), F.collect_set("service").alias("services"))
    tags = lambda x: F.from_json(x["tags_json"], "map<string,string>").alias("tags")
    t = t.select("services", "last_us", "trace_id", F.transform("spans", lambda x: F.struct(*[x[c].alias(c) for c in ("span_id", "parent_id", "service", "start_us")], tags(x))).alias("spans"))
    t = t.select("services", "last_us", F.to_json(F.struct("trace_id", "last_us", "spans")).alias("value"))
    out = t.select(F.explode("services").alias("service"), F.floor(F.col("last_us") / (bucket_s * 1_000_000)).alias("bucket"), "value")
    out.repartition("service", "bucket").write.partitionBy("service", "bucket").text(path)
