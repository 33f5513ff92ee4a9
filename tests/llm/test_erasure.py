"""Layout and erasure against the same work done with Python lists."""

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm import erasure

NAMES = ("clients", "clicks", "sales", "sale_lines")
AMOUNT = dict(zip(NAMES, ("balance", "value", "total", "amount"), strict=True))


def crc(x):
    return zlib.crc32(str("" if x is None else x).encode())


def brute(tables, files=150, masters=None):
    """Per (table, file_no): rows left, rows erased, in order; of tables as lists of dicts."""
    clicks = Counter(r["client_id"] for r in tables["clicks"] if r["client_id"] is not None)
    owned = {(r["master_id"], r["client_id"]) for r in tables["clients"] if r["master_id"] is not None}
    if masters is None:
        masters = {m for m, _ in owned if crc(m) % 100 == 0}
        total = Counter({m: 0 for m, _ in owned})
        for m, c in owned:
            total[m] += clicks[c]
        if total:
            masters.add(min(total, key=lambda m: (-total[m], m)))
    gone = {c for m, c in owned if m in masters and c is not None}
    buyer = {}
    for r in tables["sales"]:
        if r["sale_id"] is not None:
            buyer.setdefault(r["sale_id"], []).append(r["client_id"])
    buyer = {s: min((c for c in cs if c is not None), default=None) for s, cs in buyer.items()}
    gone_sales = {r["sale_id"] for r in tables["sales"] if r["client_id"] in gone and r["sale_id"] is not None}
    lost = {
        "clients": lambda r: r["client_id"] in gone or r["client_id"] is None and r["master_id"] in masters, "clicks": lambda r: r["client_id"] in gone, "sales": lambda r: r["client_id"] in gone,
        "sale_lines": lambda r: r["sale_id"] in gone_sales,
    }
    out = {}
    for name, rows in tables.items():
        by = (lambda r: crc(buyer.get(r["sale_id"]))) if name == "sale_lines" else lambda r: crc(r["client_id"])
        rows = sorted(rows, key=lambda r: (by(r), [(v is not None, v if v is not None else 0) for v in r.values()]))
        size = 1 + len(rows) // files
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            left = [r for r in part if not lost[name](r)]
            if left:
                out[name, i // size] = left, len(part) - len(left)
    return out


def check(got, want, folder):
    assert {(r.table_name, r.file_no) for r in got} == set(want)
    for r in got:
        left, erased = want[r.table_name, r.file_no]
        ids = ",".join("" if (x := next(iter(row.values()))) is None else str(x) for row in left)
        cents = sum(math.floor(100 * row[AMOUNT[r.table_name]] + 0.5) for row in left if row[AMOUNT[r.table_name]] is not None)
        assert (r.n_rows, r.n_erased, r.rewritten, r.cents, r.ids_sha256, r.columns) == (len(left), erased, erased > 0, cents, hashlib.sha256(ids.encode()).hexdigest(), ",".join(left[0]))
        file = pq.ParquetFile(r.path)
        assert file.read().to_pylist() == left and file.schema_arrow.names == list(left[0])
        stats = file.metadata.row_group(0).column(0).statistics
        known = [v for row in left if (v := next(iter(row.values()))) is not None]
        assert file.metadata.num_rows == len(left) and (not known or (stats.min, stats.max) == (min(known), max(known)))
    assert {str(p) for p in Path(folder).rglob("*.parquet")} == {r.path for r in got}


def frames(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES]


def test_query(spark, sf_dir):
    got = erasure.op12_erasure(spark, sf_dir).collect()
    tables = {n: pq.read_table(f"{sf_dir}/{n}.parquet").to_pylist() for n in NAMES}
    check(got, brute(tables), got[0].path.rsplit("/", 3)[0])


def test_untouched_files_stay_as_they_were(spark, sf_dir, tmp_path):
    clients = frames(spark, sf_dir)[0]
    layout = erasure.lay_out(clients, "clients", F.crc32(F.col("client_id").cast("string")), F.col("client_id"), f"{tmp_path}/clients", 20)
    stat = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = stat()
    erased = erasure.erase(layout, clients.where("client_id in (3, 4)").select(F.col("client_id").alias("key")))
    files = {r.file_no for r in erased.collect()}
    after = stat()
    assert {p for p in before if before[p] != after.get(p)} == {p for p in before if int(p.split("quire_file_no=")[1].split("/")[0]) in files} and len(before) == len(after)
    assert erasure.erase(layout, clients.where("client_id in (3, 4)").select(F.col("client_id").alias("key"))).where("n_erased > 0").collect() == []
    assert erasure.erase(layout, clients.where("false").select(F.col("client_id").alias("key"))).collect() == [] and stat() == after


SCHEMAS = {
    "clients": "client_id long, master_id long, h string, balance double", "clicks": "click_id long, client_id long, value double, key string", "sales": "sale_id long, client_id long, total double, file_no int, _file string, n long",
    "sale_lines": "sale_id long, line_no int, amount double, part string, run long",
}


def made(spark, rows):
    return [spark.createDataFrame(rows[n], SCHEMAS[n]).repartition(3) for n in NAMES]


def as_dicts(rows):
    return {n: [dict(zip([c.split()[0] for c in SCHEMAS[n].split(", ")], r, strict=True)) for r in rows[n]] for n in NAMES}


def test_hot_null_repeated_and_emptied(spark, tmp_path):
    rows = {
        "clients": [(1, 10, "a", 1.005), (2, 10, None, None), (3, 30, "b", -2.5), (None, 10, "c", 1.0), (None, None, None, None), (4, None, "d", 0.125), (3, 30, "b", -2.5)],
        "clicks": [(i, 1, 0.5 * i, None) for i in range(400)] + [(i, 3, None, "x") for i in range(100)] + [(None, None, None, None)] * 3 + [(7, 9, 1.0, "y")],
        "sales": [(i, 1 if i % 3 else 3, i / 8, -i, "f", None) for i in range(60)] + [(None, 1, 2.0, None, None, 5), (200, None, 1.0, 3, "g", 1)],
        "sale_lines": [(1, i % 5, 0.25, "p", i) for i in range(300)] + [(i, 1, None, None, None) for i in range(80)] + [(None, None, None, None, None)] * 2,
    }
    masters = spark.createDataFrame([(10,), (None,), (77,)], "master_id long")
    got = erasure.erase_clients(*made(spark, rows), masters, f"{tmp_path}/out", 20).collect()
    want = brute(as_dicts(rows), 20, {10})
    check(got, want, f"{tmp_path}/out")
    # the hot client fills files of its own, which are gone
    assert len({k for k in want if k[0] == "clicks"}) < 8


def test_empty_tables(spark, tmp_path):
    rows = {n: [] for n in NAMES} | {"clients": [(1, 10, "a", 1.0)]}
    masters = erasure.victim_masters(*made(spark, rows)[:2])
    assert [r.master_id for r in masters.collect()] == [10]
    assert erasure.erase_clients(*made(spark, rows), masters, f"{tmp_path}/out", 5).collect() == []
    none = spark.createDataFrame([], "master_id long")
    assert [(r.table_name, r.n_rows, r.rewritten) for r in erasure.erase_clients(*made(spark, rows), none, f"{tmp_path}/kept", 5).collect()] == [("clients", 1, False)]


def test_reserved_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="_quire_place"):
        erasure.lay_out(spark.range(3).withColumn("_quire_place", F.lit(1)), "t", F.col("id"), F.col("id"), f"{tmp_path}/t")


def test_runs_of_files(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 3), (2, 5), (None, 2)], "key long, _quire_file long")
    assert sorted(map(tuple, erasure.runs_of_files(rows).collect())) == [(1, 0, 1), (1, 3, 3), (2, 5, 5)]
