"""Event-time windows in batch, and relational capabilities over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.sources.tables import table


def events(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events")


def tumbling(df: DataFrame, width: str = "1 hour") -> DataFrame:
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def tumbling_counts(spark: SparkSession, base: str) -> DataFrame:
    return tumbling(events(spark, base))


def sliding_counts(spark: SparkSession, base: str) -> DataFrame:
    """One-hour windows every 20 minutes."""
    w = events(spark, base).groupBy(F.window("ts", "1 hour", "20 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("high"))
    return w.select(F.col("w.start").alias("start"), "n", "high")


def session_counts(spark: SparkSession, base: str) -> DataFrame:
    """Sessions of a user: gaps of 30 minutes or more end one."""
    s = events(spark, base).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def event_cube(spark: SparkSession, base: str) -> DataFrame:
    e = events(spark, base).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return e.cube("event_type", "month").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.grouping_id().alias("gid"))


def event_pivot(spark: SparkSession, base: str) -> DataFrame:
    """Entity-attribute-value rows to one record per entity (known attributes: no extra pass to list them)."""
    e = events(spark, base).select("user_id", "event_type", "value")
    return e.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count("value"))


def asof_orders(spark: SparkSession, base: str) -> DataFrame:
    """As-of join: each order with the ship date of its customer's latest earlier order (days between)."""
    o = table(spark, base, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"))
    w = Window.partitionBy("o_custkey").orderBy("at", "o_orderkey")
    return o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev_order"), F.datediff("at", F.lag("at").over(w)).alias("days"))


def pricing_summary(spark: SparkSession, base: str) -> DataFrame:
    li = table(spark, base, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price * (1 - disc)), 2).alias("revenue"), F.round(F.avg(disc), 6).alias("avg_disc"), F.count("*").alias("n"))


def regional_revenue(spark: SparkSession, base: str) -> DataFrame:
    """Five-way star join; dimensions of fixed size (25 nations, 5 regions) are left to the planner's measured broadcast."""
    li, o, c = table(spark, base, "lineitem"), table(spark, base, "orders"), table(spark, base, "customer")
    n, r = table(spark, base, "nation"), table(spark, base, "region")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_custkey").alias("customers"))


def top_parts(spark: SparkSession, base: str) -> DataFrame:
    """The three parts with the greatest quantity of each brand."""
    li, p = table(spark, base, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")), table(spark, base, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("qty"), "p_partkey")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("p_brand", "rank", "p_partkey", F.round("qty", 2).alias("qty"))


def customers_without_orders(spark: SparkSession, base: str) -> DataFrame:
    c, o = table(spark, base, "customer"), table(spark, base, "orders")
    return c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def set_operations(spark: SparkSession, base: str) -> DataFrame:
    """Nations with customers and suppliers, with either alone, by set operations."""
    c, s = table(spark, base, "customer").select(F.col("c_nationkey").alias("k")), table(spark, base, "supplier").select(F.col("s_nationkey").alias("k"))
    both = c.intersect(s).select("k", F.lit("both").alias("side"))
    return both.unionByName(c.subtract(s).select("k", F.lit("customer").alias("side"))).unionByName(s.subtract(c).select("k", F.lit("supplier").alias("side")))


def price_ntile(spark: SparkSession, base: str) -> DataFrame:
    """Parts per size that lie in the dearest tenth. The cut is the 0.9 disc percentile of the whole prices, found by
    counting in order over one row per whole price."""
    p = table(spark, base, "part").select("p_size", "p_retailprice")
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    v = p.groupBy("p_retailprice").agg(F.count("*").alias("c")).withColumn("bucket", F.floor(F.col("p_retailprice")).cast("int"))
    b = v.groupBy("bucket").agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(w))  # one row per whole price
    total = b.agg(F.sum("c").alias("n"))
    cut = b.crossJoin(F.broadcast(total)).where(F.col("upto") >= F.ceil(F.col("n") * 0.9)).agg(F.min("bucket").alias("cut"))  # one row each
    x = p.crossJoin(F.broadcast(cut)).withColumn("dear", F.floor("p_retailprice") >= F.col("cut"))
    return x.groupBy("p_size").agg(F.count("*").alias("n"), F.count_if("dear").alias("dear"))
