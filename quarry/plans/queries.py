"""The engine's queries over the test tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import nested, vectors
from quarry.operators import entries, flatten, hist, selectors, steps
from quarry.plans import file_queries
from quarry.plans.scratch import folder
from quarry.plans.table import Table


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _entries(spark: SparkSession, d: str, name: str) -> DataFrame:
    return entries.read_with_entry(spark, f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> Table:
    """events with event_id, which numbers its rows, as the entry."""
    return Table(_read(spark, d, "events").withColumnRenamed("event_id", "entry"), "events")


def _jagged(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with its line items as lists, in entry order: entry (the order), quantity, price."""
    item = F.struct("entry", "l_quantity", "l_extendedprice")
    lists = _entries(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(F.array_sort(F.collect_list(item)).alias("it"))
    return lists.select("entry", F.col("it.l_quantity").alias("quantity"), F.col("it.l_extendedprice").alias("price"))


_NUMBERED = "(SELECT *, row_number() OVER () - 1 AS entry FROM lineitem)"
_SUB = f"(SELECT l_orderkey AS entry, row_number() OVER (PARTITION BY l_orderkey ORDER BY entry) - 1 AS subentry, l_quantity AS quantity, l_extendedprice AS price, entry AS e FROM {_NUMBERED})"


def entry_all(spark, d):
    return _entries(spark, d, "lineitem").select("entry", "l_orderkey", "l_quantity")


def entry_slice(spark, d):
    return entries.slice_entries(_entries(spark, d, "lineitem"), 100, 300).select("entry", "l_orderkey", "l_linenumber")


def entry_tail(spark, d):
    return _events(spark, d).lazyarrays(["user_id", "value"], entrystart=-10).withColumnRenamed("entry", "event_id")


def select_glob(spark, d):
    return selectors.select(_read(spark, d, "customer"), ["c_*key", "c_acctbal"])


def select_regex(spark, d):
    return selectors.select(_read(spark, d, "part"), "/P_(PARTKEY|SIZE)/i")


def select_predicate(spark, d):
    return selectors.select(_read(spark, d, "supplier"), lambda b: isinstance(b.dataType, T.NumericType) or None)


def select_cast(spark, d):
    """A mapping from names to types selects and casts; numbers are cut toward zero."""
    return selectors.select(_read(spark, d, "orders"), {"o_orderkey": None, "o_total*": "bigint"})


def cast_trunc(spark, d):
    return _events(spark, d).array("value", "bigint").select(F.col("entry").alias("event_id"), F.col("value").alias("value_int"))


def numentries(spark, d):
    counts = entries.file_counts(spark, [f"{d}/{t}.parquet" for t in ("customer", "supplier", "nation")])
    return spark.createDataFrame([(os.path.basename(p).split(".")[0], n) for p, n in counts.items()], "name string, n bigint")


def steps_equal(spark, d):
    return steps.step_summary(_events(spark, d).df, 500)


def map_steps(spark, d):
    """A function on every step of 1000 entries, in parallel."""
    import pandas as pd

    fn = lambda p: pd.DataFrame({"first": [p["entry"].min()], "top": [p["value"].max()]})
    return _events(spark, d).map_steps(fn, "first bigint, top double", 1000, ["value"])


def jagged_counts(spark, d):
    return _jagged(spark, d).select("entry", nested.counts("quantity").cast("long").alias("n"))


def jagged_flatten(spark, d):
    return flatten.flatten(_jagged(spark, d)).select("entry", F.col("subentry").cast("long").alias("subentry"), "quantity", "price")


def jagged_broadcast(spark, d):
    """A scalar column repeats for each subentry."""
    own = _read(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("priority"))
    flat = flatten.flatten(_jagged(spark, d).join(own, "entry"), ["quantity", "price"])
    return flat.select("entry", F.col("subentry").cast("long").alias("subentry"), "priority", "quantity")


def jagged_concatenate(spark, d):
    return flatten.concatenate(_jagged(spark, d), "quantity").groupBy("quantity").agg(F.count("*").alias("n"))


def jagged_inner_cut(spark, d):
    cut = nested.cut_inner("price", "quantity", lambda q: q > 25)
    return _jagged(spark, d).select("entry", F.size(cut).cast("long").alias("n"), F.round(nested.total(cut), 2).alias("price"))


def jagged_outer_cut(spark, d):
    return _jagged(spark, d).where(nested.greatest("quantity") > 45).select("entry", nested.greatest("quantity").alias("top"))


def jagged_reducers(spark, d):
    return _jagged(spark, d).select(
        "entry", nested.counts("quantity").cast("long").alias("n"), nested.total("quantity").alias("total"), nested.least("quantity").alias("low"), nested.greatest("quantity").alias("high"),
        nested.any_of("quantity", lambda x: x > 40).alias("some"), nested.all_of("quantity", lambda x: x > 10).alias("every"),
    )


def jagged_argmax(spark, d):
    return _jagged(spark, d).select(
        "entry", nested.argmax("quantity").cast("long").alias("at"), nested.argmin("quantity").cast("long").alias("low_at"),
        F.element_at(nested.gather("price", F.array(nested.argmax("quantity"))), 1).alias("price"),
    )


def jagged_pick(spark, d):
    return _jagged(spark, d).where(nested.counts("quantity") > 1).select("entry", nested.pick("quantity", 0).alias("first"), nested.pick("quantity", -1).alias("last"))


def jagged_choose(spark, d):
    pairs = nested.choose("quantity", 2)
    return _jagged(spark, d).select("entry", F.size(pairs).cast("long").alias("n"), F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["i0"] * p["i1"]).alias("products"))


def jagged_cross(spark, d):
    pairs = nested.cross("quantity", "quantity")
    return _jagged(spark, d).select("entry", F.size(pairs).cast("long").alias("n"), F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.greatest(p["i0"], p["i1"])).alias("greater"))


def jagged_ufunc(spark, d):
    roots = nested.elementwise(lambda x, y: F.floor(F.sqrt(x * y)), "quantity", "price")
    return _jagged(spark, d).select("entry", nested.total(roots).alias("total"))


def jagged_nested(spark, d):
    """Lists of lists, by customer and order: their flat length and sum."""
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), "o_custkey")
    per = _jagged(spark, d).join(orders, "entry").groupBy("o_custkey").agg(F.collect_list("quantity").alias("q"))
    return per.select("o_custkey", F.size(nested.flatten_all("q")).cast("long").alias("n"), nested.total(nested.flatten_all("q")).alias("total"))


def jagged_unstack(spark, d):
    wide = flatten.unstack(flatten.flatten(_jagged(spark, d)), "quantity", 2)
    return wide.select("entry", F.col("`quantity[0]`").alias("q0"), F.col("`quantity[1]`").alias("q1"))


def drop_jagged(spark, d):
    return flatten.drop_jagged(_read(spark, d, "embeddings"))


def fixed_explode(spark, d):
    wide = flatten.explode_fixed(_read(spark, d, "embeddings"), {"embedding": (64,)})
    return wide.select("vec_id", F.col("`embedding[0]`").cast("double").alias("first"), F.col("`embedding[63]`").cast("double").alias("last"))


def struct_explode(spark, d):
    own = _read(spark, d, "customer").select("c_custkey", F.struct("c_nationkey", "c_acctbal").alias("s"))
    return flatten.explode_structs(own, lambda b, f, i: f"{b}_{f}" if f else b)


def hist_1d(spark, d):
    axis = hist.Axis(10, 0.0, 40.0)
    full = hist.complete(hist.fill(_read(spark, d, "lineitem"), "l_quantity", axis), axis)
    return full.select("bin", "sumw")


def hist_2d(spark, d):
    own = hist.fill_2d(_read(spark, d, "lineitem"), "l_quantity", "l_discount", hist.Axis(5, 0.0, 50.0), hist.Axis.variable([0.0, 0.025, 0.055, 0.2]))
    return own.select("x_bin", "y_bin", "sumw")


def hist_numpy_edges(spark, d):
    """The last bin holds its upper edge."""
    return hist.fill(_read(spark, d, "lineitem"), "l_quantity", hist.Axis(7, 1.0, 50.0), closed=True).select("bin", "sumw")


def hist_weighted(spark, d):
    own = hist.fill(_read(spark, d, "orders"), "o_totalprice", hist.Axis.variable([0.0, 1e4, 1e5, 1e6]), F.length("o_orderpriority"))
    return own.select("bin", "sumw", "sumw2")


def hist_normalized(spark, d):
    own = hist.normalize(hist.fill(_read(spark, d, "lineitem"), "l_quantity", hist.Axis(4, 0.0, 60.0)))
    return own.select("bin", F.round("sumw", 9).alias("share"))


def hist_added(spark, d):
    axis, own = hist.Axis(6, 0.0, 60.0), _read(spark, d, "lineitem")
    parts = [hist.fill(own.where(F.col("l_returnflag") == f), "l_quantity", axis) for f in ("A", "N", "R")]
    return hist.add(*parts).select("bin", "sumw")


def hist_3d(spark, d):
    """Three axes at once, as one partial aggregation."""
    axes = hist.Axis(4, 0.0, 40.0), hist.Axis.variable([0.0, 0.025, 0.055]), hist.Axis(2, 0.0, 50000.0)
    own = hist.fill_nd(_read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], axes)
    return own.select("bin_0", "bin_1", "bin_2", "sumw")


def hist_profile(spark, d):
    """Mean quantity by bins of the price, with its sums."""
    own = hist.fill_nd(_read(spark, d, "lineitem"), ["l_extendedprice"], [hist.Axis(8, 0.0, 80000.0)], y="l_quantity")
    return own.select(F.col("bin_0").alias("bin"), "sumw", "sumwy", "sumwy2", F.round(F.col("sumwy") / F.col("sumw"), 6).alias("mean"))


def union_files(spark, d):
    """Two tables as one, with entries that run on."""
    paths, names = [f"{d}/customer.parquet", f"{d}/supplier.parquet"], {"c_custkey": "key", "s_suppkey": "key", "c_acctbal": "bal", "s_acctbal": "bal"}
    own = entries.read_all(spark, paths, file="file")
    last = lambda a, b: F.coalesce(a, b)
    return own.groupBy((F.col("file") == paths[0]).alias("customers")).agg(F.min("entry").alias("low"), F.max("entry").alias("high"), F.count("*").alias("n"), F.sum(last("c_custkey", "s_suppkey")).alias(names["c_custkey"]))


def map_zip(spark, d):
    own = _jagged(spark, d).select("entry", nested.zip_map(F.sequence(F.lit(1), F.size("quantity")), F.col("quantity")).alias("m"))
    return own.select("entry", F.explode("m").alias("k", "q")).select("entry", F.col("k").cast("long").alias("k"), "q")


def vector_mass(spark, d):
    """Invariant mass and transverse momentum of vectors made of columns whose square is never negative."""
    v = vectors.cartesian(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") + F.col("l_extendedprice"))
    own = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", v.alias("v"))
    return own.groupBy("l_orderkey").agg(F.round(F.max(vectors.mass("v")), 3).alias("mass"), F.round(F.max(vectors.pt("v")), 6).alias("pt"))


def format_round_trip(spark, d):
    """A table written to the binary format and read back by its source."""
    from quarry.sources import datasource

    datasource.register(spark)
    out = folder(spark, "eventfile")
    own = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    own.write.format("eventfile").option("compression", "zstd").mode("append").save(out)
    return spark.read.format("eventfile").load(out).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def flagship(spark, d):
    """A histogram of the quantities in all line items' lists, flattened."""
    own = _entries(spark, d, "lineitem")
    lists = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("entry", "l_quantity"))).alias("it")).select(F.col("l_orderkey").alias("entry"), F.col("it.l_quantity").alias("quantity"))
    axis = hist.Axis(10, 0.0, 50.0)
    return hist.complete(hist.fill(flatten.flatten(lists), "quantity", axis), axis).select("bin", "sumw")


_BIN = "CASE WHEN {x} < {lo} THEN 0 WHEN {x} >= {hi} THEN {n} + 1 ELSE cast(floor(({x} - {lo}) / (({hi} - {lo}) / {n})) AS BIGINT) + 1 END"


def _bin(x, n, lo, hi):
    return _BIN.format(x=x, n=n, lo=f"{lo}::DOUBLE", hi=f"{hi}::DOUBLE")


def _all_bins(n, inner):
    return f"SELECT r.bin, coalesce(h.sumw, 0)::DOUBLE AS sumw FROM (SELECT unnest(range({n + 2})) AS bin) r LEFT JOIN ({inner}) h ON r.bin = h.bin"


ORACLE_SQL = {
    "entry_all": f"SELECT entry, l_orderkey, l_quantity FROM {_NUMBERED}",
    "entry_slice": f"SELECT entry, l_orderkey, l_linenumber FROM {_NUMBERED} WHERE entry >= 100 AND entry < 300",
    "entry_tail": "SELECT event_id, user_id, value FROM events WHERE event_id >= (SELECT count(*) FROM events) - 10",
    "select_glob": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "select_regex": "SELECT p_partkey, p_size FROM part",
    "select_predicate": "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier",
    "select_cast": "SELECT o_orderkey, cast(trunc(o_totalprice) AS BIGINT) AS o_totalprice FROM orders",
    "cast_trunc": "SELECT event_id, cast(trunc(value) AS BIGINT) AS value_int FROM events",
    "numentries": "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation",
    "steps_equal": "SELECT event_id // 500 AS step, min(event_id) AS entry_start, max(event_id) + 1 AS entry_stop, count(*) AS n FROM events GROUP BY 1",
    "map_steps": "SELECT min(event_id) AS first, max(value) AS top FROM events GROUP BY event_id // 1000",
    "jagged_counts": f"SELECT entry, count(*) AS n FROM {_SUB} GROUP BY entry",
    "jagged_flatten": f"SELECT entry, subentry, quantity, price FROM {_SUB}",
    "jagged_broadcast": f"SELECT entry, subentry, o_orderpriority AS priority, quantity FROM {_SUB} JOIN orders ON entry = o_orderkey",
    "jagged_concatenate": "SELECT l_quantity AS quantity, count(*) AS n FROM lineitem GROUP BY 1",
    "jagged_inner_cut": f"SELECT entry, count(*) FILTER (WHERE quantity > 25) AS n, round(coalesce(sum(price ORDER BY e) FILTER (WHERE quantity > 25), 0), 2) AS price FROM {_SUB} GROUP BY entry",
    "jagged_outer_cut": f"SELECT entry, max(quantity) AS top FROM {_SUB} GROUP BY entry HAVING max(quantity) > 45",
    "jagged_reducers": f"SELECT entry, count(*) AS n, sum(quantity) AS total, min(quantity) AS low, max(quantity) AS high, bool_or(quantity > 40) AS some, bool_and(quantity > 10) AS every FROM {_SUB} GROUP BY entry",
    "jagged_argmax": f"SELECT entry, first(subentry ORDER BY quantity DESC, subentry) AS at, first(subentry ORDER BY quantity, subentry) AS low_at, first(price ORDER BY quantity DESC, subentry) AS price FROM {_SUB} GROUP BY entry",
    "jagged_pick": f"SELECT entry, first(quantity ORDER BY subentry) AS first, last(quantity ORDER BY subentry) AS last FROM {_SUB} GROUP BY entry HAVING count(*) > 1",
    "jagged_choose": f"SELECT a.entry, count(b.entry) AS n, coalesce(sum(a.quantity * b.quantity), 0) AS products FROM {_SUB} a LEFT JOIN {_SUB} b ON a.entry = b.entry AND a.subentry < b.subentry GROUP BY a.entry",
    "jagged_cross": f"SELECT a.entry, count(*) AS n, sum(greatest(a.quantity, b.quantity)) AS greater FROM {_SUB} a JOIN {_SUB} b ON a.entry = b.entry GROUP BY a.entry",
    "jagged_ufunc": f"SELECT entry, sum(floor(sqrt(quantity * price)))::DOUBLE AS total FROM {_SUB} GROUP BY entry",
    "jagged_nested": "SELECT o_custkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "jagged_unstack": f"SELECT entry, max(quantity) FILTER (WHERE subentry = 0) AS q0, max(quantity) FILTER (WHERE subentry = 1) AS q1 FROM {_SUB} GROUP BY entry",
    "drop_jagged": "SELECT vec_id, label FROM embeddings",
    "fixed_explode": "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings",
    "struct_explode": "SELECT c_custkey, c_nationkey AS s_c_nationkey, c_acctbal AS s_c_acctbal FROM customer",
    "hist_1d": _all_bins(10, f"SELECT {_bin('l_quantity', 10, 0, 40)} AS bin, count(*) AS sumw FROM lineitem GROUP BY 1"),
    "hist_2d": f"SELECT {_bin('l_quantity', 5, 0, 50)} AS x_bin, cast(l_discount >= 0 AS BIGINT) + cast(l_discount >= 0.025 AS BIGINT) + cast(l_discount >= 0.055 AS BIGINT) + cast(l_discount >= 0.2 AS BIGINT) AS y_bin, count(*)::DOUBLE AS sumw FROM lineitem GROUP BY 1, 2",
    "hist_numpy_edges": f"SELECT CASE WHEN l_quantity = 50 THEN 7 ELSE {_bin('l_quantity', 7, 1, 50)} END AS bin, count(*)::DOUBLE AS sumw FROM lineitem GROUP BY 1",
    "hist_weighted": "SELECT cast(o_totalprice >= 0 AS BIGINT) + cast(o_totalprice >= 1e4 AS BIGINT) + cast(o_totalprice >= 1e5 AS BIGINT) + cast(o_totalprice >= 1e6 AS BIGINT) AS bin, sum(length(o_orderpriority))::DOUBLE AS sumw, sum(length(o_orderpriority) * length(o_orderpriority))::DOUBLE AS sumw2 FROM orders GROUP BY 1",
    "hist_normalized": f"SELECT {_bin('l_quantity', 4, 0, 60)} AS bin, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1",
    "hist_added": f"SELECT {_bin('l_quantity', 6, 0, 60)} AS bin, count(*)::DOUBLE AS sumw FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1",
    "hist_3d": f"SELECT {_bin('l_quantity', 4, 0, 40)} AS bin_0, cast(l_discount >= 0 AS BIGINT) + cast(l_discount >= 0.025 AS BIGINT) + cast(l_discount >= 0.055 AS BIGINT) AS bin_1, {_bin('l_extendedprice', 2, 0, 50000)} AS bin_2, count(*)::DOUBLE AS sumw FROM lineitem GROUP BY 1, 2, 3",
    "hist_profile": f"SELECT {_bin('l_extendedprice', 8, 0, 80000)} AS bin, count(*)::DOUBLE AS sumw, sum(l_quantity) AS sumwy, sum(l_quantity * l_quantity) AS sumwy2, round(sum(l_quantity) / count(*), 6) AS mean FROM lineitem GROUP BY 1",
    "union_files": "SELECT true AS customers, 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS n, sum(c_custkey)::BIGINT AS key FROM customer UNION ALL SELECT false, (SELECT count(*) FROM customer), (SELECT count(*) FROM customer) + count(*) - 1, count(*), sum(s_suppkey)::BIGINT FROM supplier",
    "map_zip": f"SELECT entry, subentry + 1 AS k, quantity AS q FROM {_SUB}",
    "vector_mass": "SELECT l_orderkey, round(max(sqrt((l_quantity + l_extendedprice) * (l_quantity + l_extendedprice) - l_quantity * l_quantity - l_discount * l_discount - l_tax * l_tax)), 3) AS mass, round(max(sqrt(l_quantity * l_quantity + l_discount * l_discount)), 6) AS pt FROM lineitem GROUP BY 1",
    "format_round_trip": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "flagship": _all_bins(10, f"SELECT {_bin('l_quantity', 10, 0, 50)} AS bin, count(*) AS sumw FROM lineitem GROUP BY 1"),
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL} | file_queries.QUERIES
ORACLE_SQL |= file_queries.ORACLE_SQL
