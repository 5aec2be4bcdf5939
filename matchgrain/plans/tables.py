"""Relational queries on the business tables: validated joins, set operations, windows, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import fold
from ..sources import neutral
from .registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def left_join_zero_fill(spark, sf_dir):
    """Denominators keep their rows; a missing numerator is zero."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_mktsegment", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT 'no order' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'ordered', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'nations of both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark, sf_dir):
    c, o, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "supplier")
    cn, sn = c.select("c_nationkey"), s.select("s_nationkey")
    parts = {
        "no order": c.join(o, c.c_custkey == o.o_custkey, "left_anti"), "ordered": c.join(o, c.c_custkey == o.o_custkey, "left_semi"),
        "nations of both": cn.intersect(sn), "only customers": cn.subtract(sn), "either": cn.union(sn).distinct(),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_row_per_key(spark, sf_dir):
    """One aggregate with map-side combine, instead of a sort of each key's rows."""
    o = _t(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount")
    )


@query("SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def metadata_joins(spark, sf_dir):
    """Orders are aggregated to customers before they meet the small tables."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    c = _t(spark, sf_dir, "customer")
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "r_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT c_custkey, lower(c_name) AS folded FROM customer WHERE contains(lower(c_name), '7')")
def folded_search(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", fold(F.col("c_name")).alias("folded")).where(F.contains("folded", F.lit("7")))


@query(neutral.SQL + " SELECT CAST(time_bucket(INTERVAL '5 minutes', ts) AS TIMESTAMP) AS start, type, count(*) AS n FROM actions GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    a = neutral.actions(spark, sf_dir)
    return a.groupBy(F.window("ts", "5 minutes").start.alias("start"), "type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS off_mean FROM orders")
def centred_values(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    mean = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return o.join(mean, "o_custkey").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") - F.col("m"), 7).alias("off_mean"))
