"""Restricted SQL over one registered table, with the same text as its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import tabular
from foliospark.plans.registry import query, table

# name -> (table read as ``dataset``, statement). All pass the validator.
STATEMENTS = {
    "tab_filter": ("lineitem", """SELECT l_orderkey, l_linenumber, l_quantity FROM dataset
        WHERE l_quantity > 45 AND NOT l_returnflag = 'A' AND l_discount IS NOT NULL OR l_tax = 0.08"""),
    "tab_like_in_between": ("orders", """SELECT o_orderkey, o_orderpriority FROM dataset
        WHERE o_orderpriority LIKE '1-%' AND o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 200000"""),
    "tab_ilike": ("part", "SELECT p_partkey, p_name FROM dataset WHERE p_name ILIKE '%A%' AND p_size BETWEEN 1 AND 30"),
    "tab_groupby": ("lineitem", """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty,
        ROUND(AVG(l_extendedprice), 4) AS avg_price, MIN(l_discount) AS min_disc, MAX(l_tax) AS max_tax
        FROM dataset GROUP BY l_returnflag, l_linestatus"""),
    "tab_sum": ("lineitem", "SELECT ROUND(SUM(l_quantity), 2) AS total FROM dataset"),
    "tab_distinct": ("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM dataset"),
    "tab_count_distinct": ("lineitem", "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM dataset"),
    "tab_having": ("orders", """SELECT o_custkey, COUNT(*) AS n FROM dataset GROUP BY o_custkey HAVING COUNT(*) > 12"""),
    "tab_orderby_limit": ("orders", "SELECT o_orderkey, o_totalprice FROM dataset ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "tab_offset": ("orders", "SELECT o_orderkey FROM dataset ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50"),
    "tab_case": ("lineitem", """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_class,
        COUNT(*) AS n FROM dataset GROUP BY 1"""),
    "tab_window": ("orders", """SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
        FROM dataset"""),
    "tab_scalar_functions": ("customer", """SELECT c_custkey, UPPER(c_name) AS name, LENGTH(c_mktsegment) AS seg_len, ABS(c_acctbal) AS bal,
        COALESCE(c_mktsegment, 'none') AS seg FROM dataset WHERE c_acctbal < 0"""),
}


def _register(name: str, source: str, statement: str) -> None:
    @query(name, statement.replace("FROM dataset", f"FROM {source}"))
    def run(spark, sf):
        return tabular.run_sql(spark, lambda s: table(s, sf, source), statement)


for _name, (_source, _statement) in STATEMENTS.items():
    _register(_name, _source, _statement)

INFERRED = ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("tab_schema_infer", "SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT {i} AS position, '{c}' AS "column", CASE
   WHEN bool_and(TRY_CAST(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.')) THEN 'INTEGER'
   WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'DOUBLE' ELSE 'TEXT' END AS inferred_type
FROM (SELECT CAST({c} AS VARCHAR) AS v FROM orders)""" for i, c in enumerate(INFERRED)) + ")")
def tab_schema_infer(spark, sf):
    strings = table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in INFERRED])
    return tabular.infer_types(strings)
