"""Two event feeds derived from the benchmark star schema, and the organization tables to match them.

The driver tables hold no organization events. Each line item becomes one event
between the nation of its customer and the nation of its supplier; line
numbers 1 and 2 go to feed A, the rest to feed B. Nothing is left out or
sampled. Names and codes get the spelling each feed uses, with unmapped actors
and unreadable codes mixed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_of_buyers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customers: joined to orders, which are fewer than line items."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    buyers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))


def _raw_events(spark: SparkSession, folder: str, fold: bool, lineitem: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    nation = table(spark, folder, "nation").join(
        F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )  # 25 and 5 rows by definition of the schema
    # Nation names come last, by broadcast, so that only their keys are shuffled.
    buying = F.broadcast(nation.select(F.col("n_nationkey").alias("b_key"), F.col("n_name").alias("buyer_nation"), F.col("r_name").alias("buyer_region")))
    selling = F.broadcast(nation.select(F.col("n_nationkey").alias("v_key"), F.col("n_name").alias("seller_nation"), F.col("r_name").alias("seller_region")))
    shipped = F.to_date("l_shipdate")
    folded = F.make_date(F.lit(1996), F.quarter("l_shipdate"), F.dayofmonth("l_shipdate").cast("int") % 28 + 1)
    return (
        (table(spark, folder, "lineitem") if lineitem is None else lineitem)
        .join(orders_of_buyers(spark, folder) if orders is None else orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(buying, F.col("c_nationkey") == F.col("b_key")).join(selling, F.col("s_nationkey") == F.col("v_key"))
        .withColumns({
            "event_day": folded if fold else shipped,
            "code_number": (F.col("l_partkey") % 20 + 1).cast("int"),
        })
    )


def _order_key() -> Column:
    """File order of an event: day first, then the unique line key."""
    return F.struct("event_day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def feed_a(spark: SparkSession, folder: str, fold: bool = False) -> DataFrame:
    """Feed A as its files look, plus event_seq. With fold, each quarter of any year maps to one month of 1996."""
    raw = _raw_events(spark, folder, fold).where("l_linenumber <= 2")
    urgent = F.col("o_orderpriority").startswith("1")
    return raw.select(
        F.date_format("event_day", "yyyy-MM-dd").alias("Event Date"),
        F.concat(F.lit("The "), "buyer_nation", F.lit(" "), "c_mktsegment", F.lit(" ("), "buyer_region", F.lit(")")).alias("Source Name"),
        F.concat("c_mktsegment", F.when(urgent, ", Government").otherwise("")).alias("Source Sectors"),
        F.concat("seller_nation", F.lit(" ["), "seller_region", F.lit("]")).alias("Target Name"),
        F.when(F.col("l_returnflag") == "R", "Business").otherwise("").alias("Target Sectors"),
        F.lpad((F.col("code_number") * 10).cast("string"), 3, "0").alias("CAMEO Code"),
        F.when(F.col("l_linestatus") == "O", F.col("seller_nation")).otherwise("").alias("City"),
        F.lit("").alias("Province"),
        F.col("seller_region").alias("Country"),
        F.concat(F.lit("Publisher "), F.col("l_returnflag")).alias("Publisher"),
        F.col("l_orderkey").cast("string").alias("Story ID"),
        F.col("l_linenumber").cast("string").alias("Sentence Number"),
        F.col("l_quantity").cast("string").alias("Intensity"),
        _order_key().alias("event_seq"),
    )


def feed_b(
    spark: SparkSession, folder: str, fold: bool = False, parties: bool = False, lineitem: DataFrame | None = None,
    orders: DataFrame | None = None,
) -> DataFrame:
    """Feed B as its files look, plus event_seq. With parties, actors are the customers and suppliers themselves.

    Line items may be given as a stream; the other tables then join statically, `orders` as a
    table of orders_of_buyers that was made before.
    """
    raw = _raw_events(spark, folder, fold, lineitem, orders).where("l_linenumber > 2")
    buyer = F.lower("c_name") if parties else F.lower("buyer_nation")
    seller = F.concat(F.lower("s_name"), F.lit(" bank")) if parties else F.lower("seller_nation")
    code = F.col("code_number")
    priority = F.col("o_orderpriority")
    line = F.col("l_linenumber")
    return raw.select(
        F.date_format("event_day", "yyyyMMdd").alias("SQLDATE"),
        F.concat(F.lit("  "), buyer, F.lit(" ")).alias("Actor1Name"),
        F.when(F.col("l_returnflag") == "A", "IGO").otherwise("").alias("Actor1KnownGroupCode"),
        F.when(priority == "1-URGENT", "GOV").when(priority == "2-HIGH", "CVL").otherwise("").alias("Actor1Type1Code"),
        F.when(F.col("l_linestatus") == "O", "MIL").otherwise("").alias("Actor1Type2Code"),
        F.lit("").alias("Actor1Type3Code"),
        F.when(priority == "5-LOW", "").otherwise(F.concat(F.lit("  "), seller)).alias("Actor2Name"),
        F.lit("").alias("Actor2KnownGroupCode"),
        F.when(F.col("l_returnflag") == "R", "BUS").otherwise("").alias("Actor2Type1Code"),
        F.lit("").alias("Actor2Type2Code"),
        F.lit("").alias("Actor2Type3Code"),
        F.when(line == 7, "210").otherwise((code * 10).cast("string")).alias("EventCode"),
        F.when(line == 6, "").when(line == 7, "x").otherwise(code.cast("string")).alias("EventRootCode"),
        F.when(code <= 5, "1").when(code <= 8, "2").when(code <= 14, "3").otherwise("4").alias("QuadClass"),
        F.col("l_quantity").cast("string").alias("NumMentions"),
        F.lit("https://example.org/").alias("SOURCEURL"),
        _order_key().alias("event_seq"),
    )


def organizations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.format_string("ORG_%06d", F.col("n_nationkey") + 1).alias("org_id"),
        F.col("n_name").alias("canonical_name"),
        F.col("n_name").alias("raw_name"),
        F.upper("n_name").alias("normalized_name"),
        F.regexp_replace("n_name", "_", " ").alias("clean_name"),
    )


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Nation and market segment names; HOUSEHOLD has none, so that some actors stay unmapped."""
    segments = table(spark, folder, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select("c_nationkey", "c_mktsegment").distinct()
    named = segments.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    alias = F.concat("n_name", F.lit(" "), "c_mktsegment")
    return named.select(
        F.format_string("ORG_%06d", F.col("n_nationkey") + 1).alias("org_id"),
        alias.alias("alias"),
        F.regexp_replace(alias, "_", " ").alias("alias_clean"),
    )
