"""Queries over written files on tables with odd values and many chunks."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quarry.plans import file_queries
from quarry.sources import datasource
from quarry.sources.writer import write_table


def against_sql(spark, name, folder, table):
    """The query's rows, and those of its SQL, as text, by the first column."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cur = con.execute(file_queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = [tuple(r[c] for c in cols) for r in file_queries.QUERIES[name](spark, str(folder)).collect()]
    return sorted(map(str, got)), sorted(map(str, cur.fetchall()))


def test_reinterpret_signs(spark, tmp_path):
    """Zeros and NaNs with a sign aren't below zero."""
    odd = np.array([-0.0, 0.0, np.nan, -np.inf, np.inf, -1.5, -5e-324, -1.7976931348623157e308, 0.0])
    odd.view(np.int64)[-1] = -1  # a NaN with a sign
    pq.write_table(pa.table({"c_custkey": range(10), "c_acctbal": pa.concat_arrays([pa.array(odd), pa.nulls(1, pa.float64())])}), tmp_path / "customer.parquet")
    got, want = against_sql(spark, "bytes_reinterpret", tmp_path, "customer")
    assert got == want


def test_range_in_few_tasks(spark, tmp_path):
    """Steps of more than TASKS share tasks: each reads the file's lists of chunks. Results don't change."""
    pq.write_table(pa.table({"o_orderkey": np.arange(30_000)}), tmp_path / "orders.parquet")
    assert file_queries.file_range(spark, str(tmp_path)).rdd.getNumPartitions() <= datasource.TASKS + 3
    got, want = against_sql(spark, "file_range", tmp_path, "orders")
    assert got == want and len(got) == 29_920


def test_pieces_of_a_task(spark, tmp_path, monkeypatch):
    """A task reads as many of its steps at once as have about TARGET bytes."""
    monkeypatch.setattr(datasource, "TARGET", "1 kB")
    monkeypatch.setattr(datasource, "TASKS", 2)
    write_table(tmp_path / "a.root", pa.table({"x": np.arange(5000)}), "tree", 70)
    datasource.register(spark)
    for step in ("33", "400 B", "2000"):
        reader = datasource.EventFile({"path": str(tmp_path / "a.root"), "step": step})
        own = reader.reader(reader.schema())
        parts = own.partitions()
        assert len(parts) <= 3 and [b.num_rows for b in own.read(parts[0])][0] in (99, 100, 2000)
        got = pa.Table.from_batches(b for p in parts for b in own.read(p))
        assert got["x"].to_pylist() == got["entry"].to_pylist() == list(range(5000))


def test_chunks_stay_with_executors(spark, tmp_path, monkeypatch):
    """Tables of more rows than a file's, in no order, are cut as one file would be; their rows don't come to the driver."""
    mixed = np.random.default_rng(1).permutation(1300)
    pq.write_table(pa.table({"event_id": mixed, "user_id": mixed % 7, "value": mixed / 3}), tmp_path / "events.parquet")
    pq.write_table(pa.table({"c_custkey": mixed, "c_acctbal": mixed / 7}), tmp_path / "customer.parquet")
    monkeypatch.setattr(file_queries, "CHUNKS", 2)
    monkeypatch.setattr(type(spark.range(0)), "toArrow", None)
    for name, table in (("chunk_sums", "events"), ("basket_ranges", "customer"), ("mempartitions", "customer")):
        got, want = against_sql(spark, name, tmp_path, table)
        assert got == want
