"""Erasure of clients from files: an index made with the layout names the files that hold a key, and only these are opened and written anew.

A table is laid out in files of consecutive rows of one sorted order, each in a folder of its own
(``quire_file_no=7``) and written by one task. Beside it goes an inverted index: for each key, the runs of
file numbers that hold it. An erasure joins its keys with these postings, which gives the files and
the keys in each, and replaces those files alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.storage import delete_folder, discard, durable, shared_folder

#: The column that names a file's folder, and in results its number. A table may have columns of any other name but those of ``OWN``.
FOLDER, FILE_NO = "quire_file_no", "file_no"
OWN = frozenset((FOLDER, "_quire_file", "_quire_place", "_quire_order", "_quire_part", "_quire_start", "_quire_at", "_quire_key", "_quire_client", "_quire_sale", "_metadata"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Layout:
    """A table in files: ``folder`` holds ``quire_file_no=N/*.parquet``; ``postings`` are (key, first_file, last_file), runs of files that hold a key, which is an expression of the columns."""

    name: str
    folder: str
    schema: T.StructType
    key: Column
    files: int
    postings: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows that are left, with their file's number."""
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(FOLDER, T.LongType())])).parquet(self.folder)


def _one_task_a_file(rows: DataFrame, files: int, order: str) -> DataFrame:
    """Rows dealt so that a file is whole in one task, in order; as many tasks as files."""
    return rows.repartitionById(files, F.col("_quire_file").cast("int")).sortWithinPartitions("_quire_file", order)


def _write(rows: DataFrame, folder: str, mode: str) -> None:
    """One file for each ``_quire_file`` that has rows; with mode overwrite only the folders of these are replaced."""
    named = rows.withColumnRenamed("_quire_file", FOLDER)
    named.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(FOLDER).parquet(folder)


def runs_of_files(rows: DataFrame) -> DataFrame:
    """(key, first_file, last_file) from (key, _quire_file) rows: each key's files in runs of consecutive numbers. Null keys have none."""
    held = rows.where("key is not null").distinct()
    run = F.col("_quire_file") - F.row_number().over(W.partitionBy("key").orderBy("_quire_file"))
    return held.withColumn("run", run).groupBy("key", "run").agg(F.min("_quire_file").alias("first_file"), F.max("_quire_file").alias("last_file")).drop("run")


def lay_out(table: DataFrame, name: str, order_key: Column, key: Column, folder: str, files: int = 150, columns: Sequence[str] | None = None) -> Layout:
    """Sort a table by ``order_key``, then all its columns (nulls first), and write 1 + floor(n / files) consecutive rows a file.

    ``columns`` are those that are written, all by default; ``order_key`` may use others. Rows are range-sorted
    on the whole row, so that a hot key is spread over tasks, and equal rows are interchangeable. An empty
    table has an empty layout. Columns may have any names but those of ``OWN``, which are refused.
    """
    spark, columns = table.sparkSession, tuple(table.columns if columns is None else columns)
    if clash := OWN & {c.lower() for c in columns}:
        raise ValueError(f"columns of the layout itself: {', '.join(sorted(clash))}")
    order = [F.asc_nulls_first("_quire_order"), *[F.asc_nulls_first(_quoted(c)) for c in columns]]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = table.withColumn("_quire_order", order_key).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*map(_quoted, columns)).withColumn("_quire_place", F.monotonically_increasing_id())
    ordered = durable(placed, "erasure-sorted")
    placed = ordered.withColumn("_quire_part", F.shiftright("_quire_place", 33))
    sizes = placed.groupBy("_quire_part").agg(F.count("*").alias("n"))
    # a row for each task of the sort, so one window over all of them is small
    starts = durable(sizes.select("_quire_part", "n", (F.sum("n").over(W.orderBy("_quire_part")) - F.col("n")).alias("_quire_start")), "erasure-starts")
    total = starts.agg(F.sum("n").alias("n")).first()["n"] or 0
    per_file = 1 + total // files
    count = -(-total // per_file)
    numbered = placed.join(starts.select("_quire_part", "_quire_start"), "_quire_part").withColumn("_quire_file", F.expr(f"(_quire_start + (_quire_place & {(1 << 33) - 1})) div {per_file}"))
    if count:
        _write(_one_task_a_file(numbered.select(*map(_quoted, columns), "_quire_file", "_quire_place"), count, "_quire_place").drop("_quire_place"), folder, "errorifexists")
    postings = durable(runs_of_files(numbered.select(key.alias("key"), "_quire_file")), f"erasure-index-{name}")
    discard(ordered)
    discard(starts)
    return Layout(name, folder, table.select(*map(_quoted, columns)).schema, key, count, postings)


def erase(layout: Layout, victims: DataFrame) -> DataFrame:
    """Erase all rows whose key is in ``victims`` (key) from a layout; (file_no, n_erased) of the files that held any, as a written table.

    The postings decide which files are read. Keys are matched file by file, so that a key that fills many
    files is as many small groups. Survivors keep their order, and a file is replaced whole by one task
    through a staging folder; files that lose all rows are removed. Running it again after a failure
    finishes the work, as what is gone has no victims left.
    """
    spark = victims.sparkSession
    found = layout.postings.join(victims.where("key is not null").select("key").distinct(), "key")
    found = durable(found.select(F.explode(F.sequence("first_file", "last_file")).alias(FILE_NO), "key"), f"erasure-found-{layout.name}")
    # numbers of files, of which a layout has a bounded count
    numbers = lambda rows: [r[0] for r in rows.select(FILE_NO).distinct().orderBy(FILE_NO).collect()]
    rows = layout.read(spark).withColumns({"_quire_file": F.col(FOLDER), "_quire_at": F.col("_metadata.row_index"), "_quire_key": layout.key}) if layout.files else None
    marked = found.select(F.col(FILE_NO).alias("_quire_file"), F.col("key").alias("_quire_key"))
    hit = numbers(found)
    if not hit:
        return spark.createDataFrame([], f"{FILE_NO} long, n_erased long")
    # what an earlier erasure has taken is still in the postings: only files that hold a victim now are replaced
    sizes = rows.where(F.col(FOLDER).isin(hit)).select("_quire_file", "_quire_key").join(marked.withColumn("_quire_gone", F.lit(1)), ["_quire_file", "_quire_key"], "left").groupBy("_quire_file").agg(F.count("*").alias("n"), F.count("_quire_gone").alias("n_erased"))
    erased = durable(sizes.where("n_erased > 0").select(F.col("_quire_file").alias(FILE_NO), "n_erased", (F.col("n") == F.col("n_erased")).alias("empty")), f"erasure-counts-{layout.name}")
    hit, empty = numbers(erased), numbers(erased.where("empty"))
    kept = rows.where(F.col(FOLDER).isin(hit)).join(marked, ["_quire_file", "_quire_key"], "left_anti").select(*map(_quoted, layout.columns), "_quire_file", "_quire_at")
    if len(empty) < len(hit):
        _write(_one_task_a_file(kept, layout.files, "_quire_at").drop("_quire_at"), layout.folder, "overwrite")
    for number in empty:
        delete_folder(spark, f"{layout.folder}/{FOLDER}={number}")
    discard(found)
    return erased.drop("empty")


def file_digests(layout: Layout, spark: SparkSession, amount: str) -> DataFrame:
    """(file_no, n_rows, cents, ids_sha256, path) of every file there is: rows, the sum of floor(100 x + 0.5) of a column, and the digest of the first column in file order.

    A file's ids are hashed as they stream through one task; two columns are read.
    """
    schema = f"{FILE_NO} long, n_rows long, cents long, ids_sha256 string, path string"
    if not layout.files:
        return spark.createDataFrame([], schema)
    cents = F.coalesce(F.floor(F.col(_quoted(amount)).cast("double") * 100 + 0.5), F.lit(0)).cast("long")
    name = layout.folder.rsplit("/", 1)[-1]
    # the folder as it was named, then the file's place in it; Spark's own form of a path is a URI
    at, path = F.col("_metadata.row_index"), F.concat(F.lit(layout.folder), F.substring_index("_metadata.file_path", f"/{name}", -1))
    rows = layout.read(spark).select(F.col(FOLDER).alias("_quire_file"), at.alias("_quire_at"), F.coalesce(F.col(_quoted(layout.columns[0])).cast("string"), F.lit("")).alias("id"), cents.alias("cents"), F.when(at == 0, path).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # files follow one another, each whole and in order
        now, digest = None, hashlib.sha256()

        def told() -> pa.RecordBatch:
            number, n, sum_of, place = now
            return pa.RecordBatch.from_pydict({FILE_NO: [number], "n_rows": [n], "cents": [sum_of], "ids_sha256": [digest.hexdigest()], "path": [place]})

        for batch in batches:
            numbers = batch.column("_quire_file").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if now is None or now[0] != numbers[i]:
                    if now is not None:
                        yield told()
                    now, digest = [int(numbers[i]), 0, 0, batch.column("path")[i].as_py()], hashlib.sha256()
                digest.update((("," if now[1] else "") + ",".join(batch.column("id").slice(i, j - i).to_pylist())).encode())
                now[1] += j - i
                now[2] += int(batch.column("cents").slice(i, j - i).to_numpy().sum())
        if now is not None:
            yield told()

    return _one_task_a_file(rows, layout.files, "_quire_at").mapInArrow(run, schema)


def victim_masters(clients: DataFrame, clicks: DataFrame) -> DataFrame:
    """(master_id): those whose crc32 is divisible by 100, and the one whose clients together have most clicks; of equals, even at none, the least."""
    masters = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    counted = clicks.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    busiest = masters.join(counted, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy(F.desc("n"), "master_id").limit(1)
    chosen = masters.select("master_id").where(F.crc32(F.col("master_id").cast("string")) % 100 == 0)
    return chosen.unionByName(busiest.select("master_id")).distinct()


def erase_clients(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, masters: DataFrame, folder: str, files: int = 150) -> DataFrame:
    """Lay the four tables out under ``folder``, erase the clients of ``masters`` with all that hangs on them, and describe every file that is left.

    Victims are clients of the masters, clicks and sales of these clients, lines of these sales. Rows are
    sorted by crc32 of their client's id (lines: of the least client of their sale), where null or unknown is
    the empty text. Returns file_no, n_rows, n_erased, cents, rewritten, table_name, ids_sha256, columns, path.
    """
    spark = clients.sparkSession
    order = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")))
    # written, so that the join reads plain shuffles on both sides: then the planner splits the task of a sale that fills a third of the lines
    buyer = durable(sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("_quire_client")).withColumnRenamed("sale_id", "_quire_sale"), "erasure-buyers")
    lines = sale_lines.join(buyer, F.col("sale_id") == F.col("_quire_sale"), "left").drop("_quire_sale")
    lines_order = F.crc32(F.coalesce(F.col("_quire_client").cast("string"), F.lit("")))
    # a client without id is known by its master
    own_key = F.coalesce(F.col("client_id").cast("string"), F.concat(F.lit("master "), F.col("master_id").cast("string")))
    gone = durable(clients.join(durable(masters, "erasure-masters"), "master_id", "left_semi").select("client_id", own_key.alias("key")).distinct(), "erasure-clients")
    gone_clients = gone.where("client_id is not null").select(F.col("client_id").alias("key")).distinct()
    gone_sales = durable(sales.join(gone_clients.withColumnRenamed("key", "client_id"), "client_id", "left_semi").where("sale_id is not null").select(F.col("sale_id").alias("key")).distinct(), "erasure-sales")
    plan = [
        (clients, "clients", order, own_key, "balance", gone.select("key")),
        (clicks, "clicks", order, F.col("client_id"), "value", gone_clients),
        (sales, "sales", order, F.col("client_id"), "total", gone_clients),
        (lines, "sale_lines", lines_order, F.col("sale_id"), "amount", gone_sales),
    ]
    told = None
    for table, name, by, key, amount, victims in plan:
        layout = lay_out(table, name, by, key, f"{folder}/{name}", files, [c for c in table.columns if c != "_quire_client"])
        erased = erase(layout, victims)
        rows = file_digests(layout, spark, amount).join(F.broadcast(erased), FILE_NO, "left").select(
            FILE_NO, "n_rows", F.coalesce("n_erased", F.lit(0)).alias("n_erased"), "cents", F.col("n_erased").isNotNull().alias("rewritten"), F.lit(layout.name).alias("table_name"), "ids_sha256",
            F.lit(",".join(layout.columns)).alias("columns"), "path",
        )
        told = rows if told is None else told.unionByName(rows)
    return told


def op12_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erase the chosen masters from a layout in a new folder under the shared one, which stays."""
    clients, clicks, sales, lines = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("clients", "clicks", "sales", "sale_lines"))
    return erase_clients(clients, clicks, sales, lines, victim_masters(clients, clicks), f"{shared_folder(spark)}/quire/erasure-{uuid.uuid4().hex}")
