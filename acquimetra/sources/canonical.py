"""The driver's tables in procurement terms: one contract vocabulary for all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

MONEY = "decimal(18,2)"
#: The same contracts in SQL, as a common table expression ``c``.
CONTRACTS_SQL = """c AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS supplier, l_partkey AS part, o_custkey AS buyer,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS value, CAST(o_orderdate AS DATE) AS signed, CAST(l_shipdate AS DATE) AS ends, o_orderpriority AS modality, o_orderstatus AS status,
 CAST(o_totalprice AS DECIMAL(18,2)) AS estimate, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def contracts(t: Tables) -> DataFrame:
    """Signed contracts: line items with their orders. Columns that a query doesn't use are pruned from both scans."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("o_custkey").alias("buyer"),
        F.col("l_extendedprice").cast(MONEY).alias("value"), F.col("o_orderdate").cast("date").alias("signed"), F.col("l_shipdate").cast("date").alias("ends"), F.col("o_orderpriority").alias("modality"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("estimate"), F.col("l_quantity").cast("long").alias("quantity"),
    )


def tenders(t: Tables) -> DataFrame:
    """Tenders: orders, with the estimate and the announcement."""
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("buyer"), F.col("o_totalprice").cast(MONEY).alias("estimate"), F.col("o_orderdate").cast("date").alias("published"), F.col("o_orderpriority").alias("modality"), F.col("o_orderstatus").alias("status"))
