"""Stream jobs from start to published result.

A job runs in up to four steps, all kept under its checkpoint folder:

1. ``ingest``: every input's lines are parsed once into good rows, late rows
   and rejects (see ``ingest``);
2. ``analysis``: the windowed query over the good rows; each micro-batch's
   result rows are kept by its number;
3. closing (bounded input only): the analysis' checkpoint is copied, and the
   copy takes one sentinel row per input, later than any date.  All windows
   end there, so the copy gives what the open windows hold if the input ended
   now.  The job's own checkpoint never sees the sentinel: rows that arrive
   later count in the windows they belong to, and the next run's closing pass
   replaces the provisional rows;
4. publishing: complete and open windows as one CSV file that replaces the
   last one.

Only the state of the analysis is copied (aggregates of open windows, never
rows of the input), so a copy's size follows windows and keys, not the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import files, sinks
from . import ingest, pipeline


@dataclass
class Input:
    """An input of a job: its lines (a stream), their parser, the columns the
    analysis needs, and the sentinel row for those columns."""

    lines: DataFrame
    parse: Callable[[DataFrame], DataFrame]
    columns: list[str]
    day_col: str
    sentinel: Callable[[DataFrame], DataFrame]

    def schema(self) -> T.StructType:
        parsed = self.parse(self.lines).select(*self.columns).schema
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in parsed.fields])


@dataclass
class StreamJob:
    """A started job.  With bounded input it has run to its end."""

    spark: SparkSession
    checkpoint: str
    out: str
    schemas: dict[str, T.StructType]
    result_schema: T.StructType
    queries: list = field(default_factory=list)

    def awaitTermination(self, timeout: int | None = None) -> None:  # noqa: N802 - the name a streaming query has
        for q in self.queries:
            q.awaitTermination(timeout)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    def folder(self, name: str) -> str:
        return ingest_folder(self.checkpoint, name)

    def rejects(self, name: str = "events") -> DataFrame:
        return ingest.rejected_lines(self.spark, self.folder(name))

    def late(self, name: str = "events") -> DataFrame:
        return ingest.late_rows(self.spark, self.folder(name), self.schemas[name])

    def log(self, name: str = "events") -> DataFrame:
        return ingest.ingest_log(self.spark, self.folder(name))

    def result(self) -> DataFrame:
        return sinks.held_result(self.spark, self.result_schema, f"{self.checkpoint}/result")

    def publish(self) -> str:
        return sinks.publish(self.spark, self.result_schema, f"{self.checkpoint}/result", self.out)


def ingest_folder(checkpoint: str, name: str) -> str:
    return f"{checkpoint.rstrip('/')}/ingest-{name}"


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_job(spark: SparkSession, build: Callable[..., DataFrame], inputs: dict[str, Input], out: str, checkpoint: str,
            trigger: dict | None = None, close: bool | None = None, state_partitions: int | None = None,
            windows: tuple[str, str | None] | None = None, delay: str = "0 seconds") -> StreamJob:
    """Start a job; ``build`` makes the result from the inputs' good rows
    (streams, given by name).

    With an ``availableNow`` trigger (the default) the input is bounded: all
    steps run to their end before this returns, and a later run on the same
    checkpoint goes on where this one stopped.  ``close=False`` leaves the
    windows open that the watermark has not passed.  With any other trigger
    the ingests and the analysis go on side by side, and the result is
    published after every micro-batch of the analysis.
    """
    checkpoint = checkpoint.rstrip("/")
    trigger = trigger or {"availableNow": True}
    bounded = trigger.get("availableNow", False)
    schemas = {name: i.schema() for name, i in inputs.items()}
    single = windows if len(inputs) == 1 else None      # two inputs: the slower watermark decides, not the input's own

    def result(ends: str) -> DataFrame:
        streams = {}
        for name in inputs:
            end = pipeline.closing_stream(spark, schemas[name], f"{ends}/{name}")
            streams[name] = ingest.good_rows(spark, ingest_folder(checkpoint, name), schemas[name]).unionByName(end)
        return build(**streams)

    def start(rows: DataFrame, keep, at: str):
        writer = rows.writeStream.foreachBatch(keep).option("checkpointLocation", at).outputMode("append").trigger(**trigger)
        return pipeline.start_with_state_partitions(spark, writer, state_partitions)

    started = []
    for name, i in inputs.items():
        q = ingest.start_ingest(i.lines, i.parse, ingest_folder(checkpoint, name), i.columns, i.day_col, single, delay, trigger)
        if bounded:
            _finish(q)
        else:
            started.append(q)

    never = result(f"{checkpoint}/never")
    job = StreamJob(spark, checkpoint, out, schemas, never.schema, started)

    def keep(rows: DataFrame, k: int) -> None:
        sinks.add_batch(rows, k, f"{checkpoint}/result")
        if not bounded:
            job.publish()

    q = start(never, keep, f"{checkpoint}/analysis")
    job.queries.append(q)
    if bounded:
        _finish(q)
        if close is not False:
            _close(spark, checkpoint, inputs, schemas, result, start)
        job.publish()
    return job


def _close(spark, checkpoint, inputs, schemas, result, start) -> None:
    """Run the analysis on a copy of its checkpoint with the sentinels."""
    scratch = scratch_path(spark, "closing")
    files.copy(spark, f"{checkpoint}/analysis", f"{scratch}/checkpoint")
    for name, i in inputs.items():
        empty = spark.createDataFrame([], schemas[name])
        i.sentinel(empty).write.parquet(f"{scratch}/ends/{name}")
    rows = result(f"{scratch}/ends")

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch}/result/batch={k}")

    _finish(start(rows, keep, f"{scratch}/checkpoint"))
    found = [f"{scratch}/result/{n}" for n in files.names(spark, f"{scratch}/result")]
    sinks.set_open(spark.read.schema(rows.schema).parquet(*found) if found else spark.createDataFrame([], rows.schema), f"{checkpoint}/result")
    files.remove(spark, scratch)
