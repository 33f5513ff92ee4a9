"""The event log of runs: parents, elapsed times, rendering, and the same over streams."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.storage import durable

#: The order of keys in a rendered event; others follow by name.
KEY_ORDER = ("event", "run_name", "run_type", "run_id", "parent_ids", "error", "tags", "elapsed", "inputs", "outputs")
LEVELS = ("debug", "info", "warning", "error", "critical")
SCHEMA = "event string, run_name string, run_type string, run_id string, parent_ids array<string>, error string, tags array<string>, elapsed string, inputs string, outputs string, timestamp timestamp, level string"


class RunLog:
    """Writes the events of runs to a log of JSON lines that ``read_log`` and ``read_log_stream`` read: one file a process, appended to.

    ``with log.run("name", "chain", inputs={...}) as run:`` writes a start event, and an end event with
    ``run.outputs`` or an error event with the exception, which goes on. Runs inside others have them as parents.
    """

    def __init__(self, folder: str):
        os.makedirs(folder, exist_ok=True)
        self.path, self._open = os.path.join(folder, f"runs-{uuid.uuid4().hex}.json"), []

    def write(self, event: str, run: Run, level: str = "info", **more) -> None:
        values = {"event": event, "run_name": run.name, "run_type": run.kind, "run_id": run.id, "parent_ids": run.parents, "tags": list(run.tags), **more}
        values |= {"timestamp": datetime.now(timezone.utc).isoformat(), "level": level}
        with open(self.path, "a") as log:
            log.write(json.dumps({k: json.dumps(v, default=str) if k in ("inputs", "outputs") else v for k, v in values.items() if v is not None}) + "\n")

    @contextmanager
    def run(self, name: str, kind: str = "chain", inputs=None, tags: Sequence[str] = ()) -> Iterator[Run]:
        run = Run(name, kind, uuid.uuid4().hex, [r.id for r in self._open], tuple(tags))
        self._open.append(run)
        began = time.perf_counter()
        self.write("start", run, inputs=inputs)
        try:
            yield run
        except BaseException as e:
            self.write("error", run, "error", error=f"{type(e).__name__}: {e}", elapsed=f"{time.perf_counter() - began:.6f}")
            raise
        else:
            self.write("end", run, outputs=run.outputs, elapsed=f"{time.perf_counter() - began:.6f}")
        finally:
            self._open.pop()


@dataclass
class Run:
    """A run of a chain, a model or a tool."""

    name: str
    kind: str
    id: str
    parents: list[str]
    tags: tuple[str, ...] = ()
    outputs: object = None


@contextmanager
def described(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs within are called ``name`` in Spark's own listings; the description before comes back."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(name)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)


def stamped(events: DataFrame) -> DataFrame:
    """Adds ``timestamp``, the time in ISO form, as text."""
    return events.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


def _climb(runs: DataFrame, start: Column, join: Callable[[Column, Column], Column]) -> DataFrame:
    """(run_id, told): walks up all parent links at once, in steps that double; ``join`` puts together what is told of an upper and of a lower part.

    Every round, each walk that is not at its end goes on by what the run that it has reached has walked so far;
    walks at their end are kept aside. A walk of more steps than there are runs goes in a circle.
    """
    known = runs.select(F.col("run_id").alias("known")).distinct()
    edges = runs.select("run_id", "parent_id").join(known, F.col("parent_id") == F.col("known"), "left")
    walks = durable(edges.select("run_id", F.col("known").alias("top"), start.alias("told")), "trace")
    total, steps = runs.count(), 1
    ended = [walks.where("top is null")]
    while not (going := walks.where("top is not null")).isEmpty():
        if steps > total:
            raise ValueError(f"run {going.first()['run_id']} is among its own ancestors, or below such a run")
        above = reduce(DataFrame.unionByName, [going, *ended]).select(F.col("run_id").alias("a"), F.col("top").alias("higher"), F.col("told").alias("upper"))
        joined = going.join(above, F.col("top") == F.col("a"))
        walks = durable(joined.select("run_id", F.col("higher").alias("top"), join(F.col("upper"), F.col("told")).alias("told")), "trace")
        ended.append(walks.where("top is null"))
        steps *= 2
    return reduce(DataFrame.unionByName, ended).select("run_id", "told")


def parent_ids(runs: DataFrame) -> DataFrame:
    """(run_id, parent_ids): the ancestors of rows (run_id, parent_id), root first; a walk stops at an unknown parent.

    A chain of n takes log2(n) rounds, however long it is. A cycle is an error of the log and raises. ``run_id`` is unique.
    """
    none = F.array().cast(f"array<{dict(runs.dtypes)['run_id']}>")
    start = F.when(F.col("known").isNotNull(), F.array("known")).otherwise(none)
    return _climb(runs, start, lambda upper, lower: F.concat(upper, lower)).withColumnRenamed("told", "parent_ids")


def depths(runs: DataFrame) -> DataFrame:
    """(run_id, depth, root): the number of ancestors of each run and the first of them, itself if it has none; for logs whose paths together are too long to write."""
    start = F.struct(F.col("known").isNotNull().cast("long").alias("depth"), F.coalesce("known", "run_id").alias("root"))
    told = _climb(runs, start, lambda upper, lower: F.struct((upper["depth"] + lower["depth"]).alias("depth"), upper["root"].alias("root")))
    return told.select("run_id", "told.depth", "told.root")


def elapsed(events: DataFrame) -> DataFrame:
    """(run_id, elapsed): seconds from the first start to the last end or error of a run; runs without both are left out. One aggregation."""
    got = events.groupBy("run_id").agg(F.min(F.when(F.col("event") == "start", F.col("ts"))).alias("s"), F.max(F.when(F.col("event").isin("end", "error"), F.col("ts"))).alias("e"))
    seconds = (F.unix_micros(F.col("e").cast("timestamp")) - F.unix_micros(F.col("s").cast("timestamp"))) / 1e6
    return got.where("s is not null and e is not null").select("run_id", seconds.alias("elapsed"))


def elapsed_stream(starts: DataFrame, ends: DataFrame, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Start and end streams (run_id, ts) joined within ``longest``; watermarks let the state of older runs go."""
    s = starts.select(F.col("run_id").alias("start_id"), F.col("ts").alias("start_ts")).withWatermark("start_ts", late)
    e = ends.select("run_id", F.col("ts").alias("end_ts")).withWatermark("end_ts", late)
    on = (F.col("start_id") == F.col("run_id")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"interval {longest}"))
    return s.join(e, on).select("run_id", "start_ts", "end_ts", (F.unix_micros("end_ts") - F.unix_micros("start_ts")).alias("micros"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events of each type in windows (tumbling, or sliding by ``slide``), of a stream or table with ``ts``; rows of a stream later than the watermark are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): events of a user without a gap that long, of a stream or table."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def render(events: DataFrame, level: str = "info") -> DataFrame:
    """JSON lines (column ``value``) of the events of at least that level, keys in their fixed order and others by name; nulls are left out."""
    least = LEVELS.index(level)
    keys = [k for k in KEY_ORDER if k in events.columns] + sorted(c for c in events.columns if c not in KEY_ORDER)
    rows = events.where(F.col("level").isin(*LEVELS[least:])) if "level" in events.columns else events
    return rows.select(F.to_json(F.struct(*keys)).alias("value"))


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def read_log_stream(spark, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)
