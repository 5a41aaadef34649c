"""Structured Streaming over the landing folder: the batch operators, kept up to date.

* ``stream_lines`` reads landed files line by line; ``load`` is the batch parser, so nothing is dropped:
  rejected lines come out as skips.
* ``window_counts`` keeps tumbling comparison windows per endpoint under a watermark.
* ``session_turns`` keeps, per session, the last request's unit fingerprints and emits each turn's event.
  Rows wait until the watermark has passed them and leave in order of instant, then place; a row behind the
  watermark goes out marked late. Batch stays the authority; on data in order both agree.
* ``close_windows`` runs the batch analysis of whole windows in foreachBatch: arrived records wait in a table
  until the watermark has passed their window's end. Windows never compare with each other, so cohorts,
  templates and defects are those of the batch; sessions that go on in another window are seen in parts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prefixlens.functions.times import rfc3339_nanos, rfc3339_seconds, window_start
from prefixlens.operators.ordering import row_numbers
from prefixlens.operators.projection import CONTENT_KINDS, project
from prefixlens.options import AnalysisOptions
from prefixlens.plans.pipeline import NothingToAnalyse, analyse_loaded, write_tables
from prefixlens.sources import records as R
from prefixlens.sources.tables import pieces


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """(input_line, line, place) of landed files.

    ``place`` orders lines by their file's time, its path, and where they stand in it. ``input_line`` is the second
    of the file since 2020 and the line's place in it: in order, but not unique among files of one second.
    """
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    meta = F.col("_metadata")
    lines = reader.load(folder).select(F.unix_micros(meta["file_modification_time"]).alias("t"), meta["file_path"].alias("file"), meta["file_block_start"].cast("bigint").alias("block"), F.octet_length("value").cast("bigint").alias("size"), F.col("value").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task reads blocks one after the other, each in order
        now, at = None, 0
        for b in batches:
            numbers, places = [], []
            for t, file, block, size in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (file, block) != now:
                    now, at = (file, block), block + (block > 0)
                numbers.append((max(t // 1_000_000 - EPOCH, 0) & (1 << 30) - 1) << 33 | at & (1 << 33) - 1)
                places.append(f"{t:020d}{file}\0{at:020d}")
                at += size + 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), b.column(4), pa.array(places, pa.string())], names=["input_line", "line", "place"])

    return lines.mapInArrow(number, "input_line bigint, line string, place string")


def load(lines: DataFrame, options: AnalysisOptions = AnalysisOptions()) -> DataFrame:
    """RECORD rows of streamed lines, with their place (no occurrence numbers and no record budget: those need a whole file)."""

    def one(line: str) -> dict:
        if not line.strip(" \t\r\f"):
            raise R.Skip("EmptyLine")
        if (size := len(line.encode())) > options.max_payload_bytes:
            raise R.Skip("RecordTooLarge", bytes=size, limit=options.max_payload_bytes)
        return R.load_line(line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for out in R._batches(iter([b.select(["input_line", "line"])]), one):
                yield out.append_column("place", b.column("place"))

    return lines.select("input_line", F.coalesce("line", F.lit("")).alias("line"), "place").mapInArrow(run, PLACED)


def timed(records: DataFrame) -> DataFrame:
    """Accepted records with request_id (content digest) and event time."""
    accepted = records.where(F.col("skip_code").isNull())
    return accepted.drop("skip_code", "skip_args").withColumn("request_id", F.concat("id_hash", F.lit(":0"))).withColumn("event_time", F.timestamp_seconds(rfc3339_seconds("captured_at"))).where("event_time IS NOT NULL")


def window_counts(records: DataFrame, options: AnalysisOptions = AnalysisOptions(), delay: str = "10 minutes") -> DataFrame:
    width = f"{options.comparison_window_seconds} seconds"
    rows = timed(records).withWatermark("event_time", delay)
    return rows.groupBy(F.window("event_time", width), "endpoint_key").agg(F.count(F.lit(1)).alias("records")).select(F.unix_timestamp("window.start").alias("time_window_key"), "endpoint_key", "records")


#: Loaded records with their place in the landing folder.
PLACED = f"{R.RECORD}, place string"
#: 2020-01-01 in seconds.
EPOCH = 1577836800
TURN = "session_key string, request_id string, previous_request_id string, event_type string, lcp_units bigint, lcp_bytes bigint, next_total_bytes bigint, late boolean"
_STATE = "last string, waiting string"


def classify(before: list, after: list) -> tuple[str, int]:
    """(kind of turn, common units) of two unit lists of (fingerprint, bytes, content?)."""
    lcp = next((i for i, (a, b) in enumerate(zip(before, after)) if a[0] != b[0]), min(len(before), len(after)))
    old, new = [u[0] for u in before if u[2]], [u[0] for u in after if u[2]]
    kept = next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
    if lcp == len(before) or (kept == len(old) and len(new) > len(old)):
        return "append", lcp
    if old and len(set(old)) == len(old) and sorted(old) == sorted(new):
        return "reorder", lcp
    return ("reset" if kept == 0 else "fork"), lcp


def session_turns(records: DataFrame, options: AnalysisOptions = AnalysisOptions(), delay: str = "10 minutes") -> DataFrame:
    rows = project(timed(records).drop("event_time"), options, ("place",)).where("skip_code IS NULL AND session_key IS NOT NULL")
    slim = rows.select(
        "session_key", F.timestamp_seconds(rfc3339_seconds("captured_at")).alias("event_time"), rfc3339_nanos("captured_at").cast("bigint").alias("ts"), "place", "request_id",
        F.to_json(F.transform("units", lambda u: F.array(u["fp"], u["bytes"].cast("string"), u["kind"].isin(*CONTENT_KINDS).cast("string")))).alias("units"),
    ).withWatermark("event_time", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (json.loads(x) for x in state.get) if state.exists else (None, [])
        mark = state.getCurrentWatermarkMs() * 1_000_000
        out = []
        for f in frames:
            for r in f.itertuples():
                units = [(fp, int(n), c == "true") for fp, n, c in json.loads(r.units)]
                if int(r.ts) < mark:
                    out.append((key[0], r.request_id, None, None, None, None, None, True))
                else:
                    waiting.append([int(r.ts), r.place, r.request_id, units])
        waiting.sort(key=lambda w: w[:2])
        ready = [w for w in waiting if w[0] < mark]
        waiting = waiting[len(ready) :]
        for _, _, request, units in ready:
            if last is not None:
                kind, lcp = classify(last[1], units)
                out.append((key[0], request, last[0], kind, lcp, sum(u[1] for u in last[1][:lcp]), sum(u[1] for u in units), False))
            last = [request, units]
        state.update((json.dumps(last), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURN.split(", ")]).astype({"lcp_units": "Int64", "lcp_bytes": "Int64", "next_total_bytes": "Int64"})

    return slim.groupBy("session_key").applyInPandasWithState(step, TURN, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def window_sink(folder: str, options: AnalysisOptions = AnalysisOptions()) -> Callable[[DataFrame, int], None]:
    """An ``analyse`` for ``close_windows`` that keeps the batch analysis as tables, a partition per batch id.

    A batch that comes again replaces what it wrote, so every window is in the tables once.
    """

    def analyse(records: DataFrame, epoch: int) -> None:
        if not records.where("skip_code IS NULL").isEmpty():
            try:
                write_tables(analyse_loaded(records, options), folder, epoch)
            except NothingToAnalyse:
                pass

    return analyse


def close_windows(records: DataFrame, analyse: Callable[[DataFrame, int], None], checkpoint: str, options: AnalysisOptions = AnalysisOptions(), delay: str = "10 minutes", late: Callable[[DataFrame, int], None] | None = None):
    """Start a query that hands loaded records to ``analyse`` (batch pipeline, batch id), each window whole.

    A window is handed over once, when the watermark (latest event less ``delay``) has passed its end; records
    of windows handed over before go to ``late``. Skips and records without a valid time belong to no window
    and go out with their batch, which may so hold nothing to analyse. A batch that is repeated after a failure
    hands over the same rows. Waiting records and watermarks are kept in the checkpoint folder.
    """
    spark, width, base = records.sparkSession, options.comparison_window_seconds, f"{checkpoint}/windows"
    wait = spark.range(1).select(F.expr(f"unix_seconds(timestamp_seconds(0) + INTERVAL {delay})")).first()[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def step(df: DataFrame, epoch: int) -> None:
        session = df.sparkSession
        seconds = rfc3339_seconds("captured_at")
        window = F.when(F.col("skip_code").isNull(), window_start(seconds, width))
        df.withColumns({"_at": seconds, "_window": window}).write.mode("overwrite").partitionBy("_window").parquet(f"{base}/arrived/_epoch={epoch}")
        schema = f"{PLACED}, _at bigint, _epoch bigint, _window bigint"
        arrived = session.read.schema(schema).option("basePath", f"{base}/arrived").parquet(f"{base}/arrived")
        marks = session.read.schema("mark bigint, _epoch bigint").parquet(f"{base}/marks").where(F.col("_epoch") < epoch) if files.exists(path(f"{base}/marks")) else None
        before = marks.agg(F.max("mark")).first()[0] if marks is not None else None
        newest = arrived.where((F.col("_epoch") == epoch) & F.col("_window").isNotNull()).agg(F.max("_at")).first()[0]
        mark = max((m for m in (before, None if newest is None else newest - wait) if m is not None), default=None)
        session.createDataFrame([(mark,)], "mark bigint").write.mode("overwrite").parquet(f"{base}/marks/_epoch={epoch}")
        end = F.col("_window") + width
        gone = F.lit(False) if before is None else F.coalesce(end <= before, F.lit(False))
        closed = F.lit(False) if mark is None else F.coalesce(end <= mark, F.lit(False)) & ~gone
        # in a window each record has its own number, in the order of landing
        whole = row_numbers(arrived.where((F.col("_epoch") <= epoch) & closed), [], ["place"], "_n").withColumn("input_line", F.col("_n").cast("bigint"))
        at_once = arrived.where((F.col("_epoch") == epoch) & F.col("_window").isNull())
        names = [c for c in df.columns if c != "place"]
        out = whole.select(names).unionByName(at_once.select(names))
        if not out.isEmpty():
            analyse(out, epoch)
        behind = arrived.where((F.col("_epoch") == epoch) & gone).select(names)
        if late is not None and not behind.isEmpty():
            late(behind, epoch)
        # what earlier batches have handed over; this one's may be asked for again
        for folder in files.globStatus(path(f"{base}/arrived/_epoch=*/_window=*")) or []:
            name = folder.getPath().getName().split("=")[1]
            old = int(folder.getPath().getParent().getName().split("=")[1]) < epoch
            if old and (not name.lstrip("-").isdigit() or (before is not None and int(name) + width <= before)):
                files.delete(folder.getPath(), True)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
