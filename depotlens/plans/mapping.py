"""Domain views over the star-schema tables: stores, tenants, repositories, releases, chunks and file references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.sources.tables import table

#: Total order of the references of a release.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def stores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("store_id"), F.col("r_name").alias("store_name"))


def tenants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("tenant_name"), F.lower("n_name").alias("slug"), F.col("n_regionkey").alias("store_id"))


def repositories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("repo_name"), F.col("c_nationkey").alias("tenant_id"), F.col("c_mktsegment").alias("storage_class"))


def releases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("repo_id"), F.concat(F.lit("1.0."), F.col("o_orderkey").cast("string")).alias("version"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("state")
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("chunk_id"), (F.col("p_size") * 1024).cast("bigint").alias("length"), (F.col("p_size") * 512 + F.col("p_partkey") % 512).cast("bigint").alias("compressed_length")
    )


def references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def file_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Ordered chunk list of each file (release, component)."""
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy(*LINE_ORDER)
    return references(spark, d).select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("chunk_id"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(x) for x in ("Reader", "Writer", "Maintainer", "Owner")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("account_name"), F.col("s_nationkey").alias("tenant_id"), role.alias("role"))


#: The same views for the SQL side.
SQL_VIEWS = """
store AS (SELECT r_regionkey store_id, r_name store_name FROM region),
tenant AS (SELECT n_nationkey tenant_id, n_name tenant_name, lower(n_name) slug, n_regionkey store_id FROM nation),
repo AS (SELECT c_custkey repo_id, c_name repo_name, c_nationkey tenant_id, c_mktsegment storage_class FROM customer),
rel AS (SELECT o_orderkey release_id, o_custkey repo_id, '1.0.' || o_orderkey AS version, o_orderdate created_at, o_orderstatus state FROM orders),
chk AS (SELECT p_partkey chunk_id, CAST(p_size * 1024 AS BIGINT) length, CAST(p_size * 512 + p_partkey % 512 AS BIGINT) compressed_length FROM part),
fc AS (SELECT l_orderkey release_id, l_suppkey component, l_partkey chunk_id,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 idx FROM lineitem),
acc AS (SELECT s_suppkey account_id, s_name account_name, s_nationkey tenant_id, ['Reader', 'Writer', 'Maintainer', 'Owner'][CAST(s_suppkey % 4 + 1 AS INT)] AS role FROM supplier)
"""


def sql(body: str) -> str:
    """A query over the views; ``body`` starts with further views (after a comma) or with SELECT."""
    return "WITH " + SQL_VIEWS.strip() + ("" if body.lstrip().startswith(",") else " ") + body
