"""The star schema's tables as a property graph: nodes (id, labels, name, pos) and edges (id, type, source, target).

``NODES_SQL`` and ``EDGES_SQL`` say the same in DuckDB's SQL, as the start of a WITH list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    label = lambda *x: F.array(*[F.lit(v) for v in x])
    return reduce(
        DataFrame.unionByName,
        [
            t("customer").select(_id("customer", "c_custkey").alias("id"), F.array(F.lit("Customer"), "c_mktsegment").alias("labels"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos")),
            t("supplier").select(_id("supplier", "s_suppkey").alias("id"), label("Supplier", "Organization").alias("labels"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos")),
            t("nation").select(_id("nation", "n_nationkey").alias("id"), label("Nation").alias("labels"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos")),
            t("region").select(_id("region", "r_regionkey").alias("id"), label("Region").alias("labels"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("pos")),
            t("part").select(_id("part", "p_partkey").alias("id"), F.array(F.lit("Part"), "p_brand").alias("labels"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")),
        ],
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With duplicates (SUPPLIES), self-loops after a remap (PEER) and dangling ends (PLACED)."""
    t = lambda name: table(spark, sf_dir, name)

    def edge(df: DataFrame, kind: str, key, source, target) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}_"), key).alias("id"), F.lit(kind).alias("type"), source.alias("source"), target.alias("target"))

    peers = t("customer").filter("c_custkey > 1")
    return reduce(
        DataFrame.unionByName,
        [
            edge(t("customer"), "IN_NATION", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), _id("customer", "c_custkey"), _id("nation", "c_nationkey")),
            edge(t("supplier"), "IN_NATION", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")),
            edge(t("nation"), "IN_REGION", F.col("n_nationkey").cast("string"), _id("nation", "n_nationkey"), _id("region", "n_regionkey")),
            edge(t("lineitem"), "SUPPLIES", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), _id("supplier", "l_suppkey"), _id("part", "l_partkey")),
            edge(peers, "PEER", F.col("c_custkey").cast("string"), _id("customer", "c_custkey"), F.concat(F.lit("customer_"), (F.col("c_custkey") - 1).cast("string"))),
            edge(t("orders").filter("o_orderstatus = 'P'"), "PLACED", F.col("o_orderkey").cast("string"), _id("customer", "o_custkey"), _id("order", "o_orderkey")),
        ],
    )


def canonical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, canonical_id): every tenth customer and every fifth supplier is a duplicate of the one before."""
    t = lambda name: table(spark, sf_dir, name)
    customers = t("customer").filter("c_custkey % 10 = 3").select(_id("customer", "c_custkey").alias("node_id"), F.concat(F.lit("customer_"), (F.col("c_custkey") - 1).cast("string")).alias("canonical_id"))
    suppliers = t("supplier").filter("s_suppkey % 5 = 2").select(_id("supplier", "s_suppkey").alias("node_id"), F.concat(F.lit("supplier_"), (F.col("s_suppkey") - 1).cast("string")).alias("canonical_id"))
    return customers.unionByName(suppliers)


NODES_SQL = """
nodes AS (
  SELECT 'customer_' || c_custkey AS id, ['Customer', c_mktsegment] AS labels, c_name AS name, c_custkey::BIGINT AS pos FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, ['Supplier', 'Organization'], s_name, s_suppkey FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, ['Nation'], n_name, n_nationkey FROM nation
  UNION ALL SELECT 'region_' || r_regionkey, ['Region'], r_name, r_regionkey FROM region
  UNION ALL SELECT 'part_' || p_partkey, ['Part', p_brand], p_name, p_partkey FROM part)"""
EDGES_SQL = """
edges AS (
  SELECT 'IN_NATION_c' || c_custkey AS id, 'IN_NATION' AS type, 'customer_' || c_custkey AS source, 'nation_' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'IN_NATION_s' || s_suppkey, 'IN_NATION', 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier
  UNION ALL SELECT 'IN_REGION_' || n_nationkey, 'IN_REGION', 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation
  UNION ALL SELECT 'SUPPLIES_' || l_orderkey || '.' || l_linenumber, 'SUPPLIES', 'supplier_' || l_suppkey, 'part_' || l_partkey FROM lineitem
  UNION ALL SELECT 'PEER_' || c_custkey, 'PEER', 'customer_' || c_custkey, 'customer_' || (c_custkey - 1) FROM customer WHERE c_custkey > 1
  UNION ALL SELECT 'PLACED_' || o_orderkey, 'PLACED', 'customer_' || o_custkey, 'order_' || o_orderkey FROM orders WHERE o_orderstatus = 'P')"""
MAP_SQL = """
remap AS (
  SELECT 'customer_' || c_custkey AS node_id, 'customer_' || (c_custkey - 1) AS canonical_id FROM customer WHERE c_custkey % 10 = 3
  UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier_' || (s_suppkey - 1) FROM supplier WHERE s_suppkey % 5 = 2)"""
