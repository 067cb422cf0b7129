"""Bronze to silver to gold: conforming, de-duplicating and aggregating the monitored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden.operators.keyed import latest_per_key


def newest(raw: DataFrame, keys: Sequence[str], recency: str) -> DataFrame:
    """Newest row per natural key; equal timestamps are settled by the remaining columns."""
    ties = [F.col(c) for c in raw.columns if c not in keys and c != recency]
    return latest_per_key(raw, keys, [F.col(recency).desc_nulls_last(), *ties])


def conform_customers(rows: DataFrame) -> DataFrame:
    return rows.select(
        "customer_id",
        F.lower(F.trim("email")).alias("email"),
        F.trim("full_name").alias("full_name"),
        F.upper("country").alias("country"),
        "created_at",
        "updated_at",
    )


def silver_customers(raw: DataFrame) -> DataFrame:
    return conform_customers(newest(raw, ["customer_id"], "updated_at"))


def silver_products(raw: DataFrame) -> DataFrame:
    """Active products; the newest version decides whether a product is active."""
    return newest(raw, ["product_id"], "updated_at").filter("is_active").select(
        "product_id",
        "sku",
        "name",
        F.lower("category").alias("category"),
        F.col("price_usd").cast("double").alias("price_usd"),
        "is_active",
        "updated_at",
    )


def conform_orders(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return rows.select(
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        "order_ts",
        F.lower("status").alias("status"),
        F.col("amount_usd").cast("double").alias("amount_usd"),
        F.to_date("order_ts").alias("order_date"),
        *carry,
    )


def silver_orders(raw: DataFrame, keys: Sequence[str] = ("order_id",)) -> DataFrame:
    return conform_orders(newest(raw, list(keys), "order_ts"))


def lag_minutes(processed: Column | str, happened: Column | str) -> Column:
    """Whole seconds between two timestamps, in minutes."""
    return ((F.unix_timestamp(processed) - F.unix_timestamp(happened)) / F.lit(60.0)).cast("double")


def silver_events(raw: DataFrame) -> DataFrame:
    return newest(raw, ["event_id"], "process_ts").select(
        "event_id",
        "customer_id",
        "product_id",
        F.lower("event_type").alias("event_type"),
        "event_ts",
        "process_ts",
        lag_minutes("process_ts", "event_ts").alias("lag_minutes"),
    )


def silver_reviews(raw: DataFrame) -> DataFrame:
    return newest(raw, ["review_id"], "review_ts").select(
        "review_id", "customer_id", "product_id", "rating", "review_text", "review_ts"
    )


def dim_customer(customers: DataFrame) -> DataFrame:
    """Initial load of the customer history: every version is the current one."""
    return customers.select(
        "customer_id",
        "email",
        "full_name",
        "country",
        F.col("created_at").alias("effective_from"),
        F.lit(None).cast("timestamp").alias("effective_to"),
        F.lit(True).alias("is_current"),
        F.col("updated_at").alias("source_updated_at"),
    )


def dim_product(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", "sku", "name", "category", "price_usd", "is_active", "updated_at"
    )


def fact_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        "order_ts",
        "order_date",
        "status",
        "amount_usd",
    )


def money_sum(amount: Column | str) -> Column:
    """Sum of money independent of row order: summed as decimals, given back as a double."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def daily_order_metrics(fact: DataFrame) -> DataFrame:
    """Orders, units, revenue and distinct customers per day.

    The distinct count makes Spark aggregate by (day, customer) first, so a hot day is spread over its
    customers.
    """
    return fact.groupBy("order_date").agg(
        F.count("*").alias("order_count"),
        F.sum("quantity").cast("long").alias("units_sold"),
        F.round(money_sum("amount_usd"), 2).alias("revenue_usd"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


_TRACKED = ("email", "full_name", "country")


def scd2_apply(dim: DataFrame, incoming: DataFrame, tracked: Sequence[str] = _TRACKED) -> DataFrame:
    """Fold a customer snapshot into the history: close changed versions, open new ones.

    One full outer join on the key; each match yields the one or two versions it leads to. A snapshot row
    that is no newer than the open version is late and changes nothing.
    """
    history = dim.filter(~F.col("is_current"))
    old = dim.filter("is_current").select(F.col("customer_id"), F.struct(*dim.columns).alias("o"))
    new = dim_customer(incoming).withColumn("effective_from", F.col("source_updated_at"))
    new = new.select(F.col("customer_id"), F.struct(*dim.columns).alias("n"))

    changed = reduce(Column.__or__, [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in tracked])
    newer = F.coalesce(F.col("n.effective_from") > F.col("o.effective_from"), F.lit(True))
    closed = (
        F.col("o")
        .withField("effective_to", F.col("n.effective_from"))
        .withField("is_current", F.lit(False))
    )
    versions = (
        F.when(F.col("n").isNull(), F.array("o"))
        .when(F.col("o").isNull(), F.array("n"))
        .when(changed & newer, F.array(closed, F.col("n")))
        .otherwise(F.array("o"))
    )
    folded = old.join(new, "customer_id", "full_outer").select(F.inline(versions))
    return history.unionByName(folded)


def layer_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def orphan_keys(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Order references to customers or products that do not exist."""
    no_customer = orders.join(customers.select("customer_id"), "customer_id", "left_anti").select(
        "order_id", F.lit("customer_id").alias("key_name"), F.col("customer_id").alias("key_value")
    )
    no_product = orders.join(products.select("product_id"), "product_id", "left_anti").select(
        "order_id", F.lit("product_id").alias("key_name"), F.col("product_id").alias("key_value")
    )
    return no_customer.unionByName(no_product)
