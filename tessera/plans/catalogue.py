"""Queries by name, each with SQL that gives the same rows.

Most run a statement of the dialect over the Parquet tables; the oracle is that statement too unless dialects differ.
Mutations return the table as the statement leaves it.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.errors import SqlError
from tessera.functions.predicates import COMPAT, STANDARD, compare
from tessera.operators import dml, relational
from tessera.operators.exchange import exchange
from tessera.plans import sql as P
from tessera.plans.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Files(Mapping):
    """The tables of a folder of Parquet files, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __iter__(self) -> Iterator[str]:
        return iter(())

    def __len__(self) -> int:
        return 0


def query(spark: SparkSession, folder: str, text: str, mode: str = STANDARD) -> DataFrame:
    return relational.select(P.parse(text), Files(spark, folder), mode)


def changed(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The table as INSERT, UPDATE or DELETE leaves it."""
    s = P.parse(text)
    df = Files(spark, folder)[s.table]
    if isinstance(s, P.Insert):
        return df.unionByName(dml.rows_to_insert(spark, df.schema, s.columns, s.rows))
    match = dml.matching(df, s.table, s.where)
    return dml.deleted(df, match) if isinstance(s, P.Delete) else dml.updated(df, match, dml.assigned(df.schema, s.sets))


def _add(name: str, text: str, oracle: str | None = None, mode: str = STANDARD, rounded: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder, text, mode)
        return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df

    QUERIES[name], ORACLES[name] = run, oracle or text


def _change(name: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, folder: changed(spark, folder, text)
    ORACLES[name] = oracle


_add("stock_level", "SELECT COUNT(DISTINCT l_partkey) AS stock_count FROM orders, lineitem WHERE o_orderkey >= 100 AND o_orderkey < 300 AND l_orderkey = o_orderkey AND l_quantity < 20")
_add("stock_level_all", "SELECT COUNT(DISTINCT l_partkey) AS stock_count, COUNT(*) AS lines FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 20")
# scans and filters
_add("seq_scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02")
_add("index_point", "SELECT * FROM orders WHERE o_orderkey = 777")
_add("index_range", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
_add("composite_prefix", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 42 AND l_linenumber >= 2")
_add("residual_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300 AND o_orderstatus = 'F'")
_add("literal_left", "SELECT l_orderkey, l_quantity FROM lineitem WHERE 20 > l_quantity")
_add("col_col_same_table", "SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_suppkey = l_partkey")
_add("nested_and", "SELECT s_suppkey FROM supplier WHERE (s_suppkey >= 2 AND (s_suppkey <= 7 AND s_nationkey >= 0))")
_add("text_compare", "SELECT n_nationkey, n_name FROM nation WHERE n_name >= 'M'")
# projection
_add("project_reorder_dup", "SELECT n_name, n_regionkey, n_nationkey, n_name AS n_name_again FROM nation")
_add("default_labels", "SELECT COUNT(*), COUNT(n_name), SUM(n_nationkey) FROM nation", 'SELECT COUNT(*) AS "count(*)", COUNT(n_name) AS "count(n_name)", CAST(SUM(n_nationkey) AS BIGINT) AS "sum(n_nationkey)" FROM nation')
_add("select_star_two_tables", "SELECT * FROM region, nation WHERE r_regionkey = n_regionkey")
# joins
_add("cross_join", "SELECT r_name, n_name FROM region, nation")
_add("cross_join_three", "SELECT r_name, n_name, s_suppkey FROM region, nation, supplier")
_add("three_table_equi", "SELECT r_name, n_name, s_suppkey FROM region, nation, supplier WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey")
_add("hash_join", "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey")
_add("index_lookup_join", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
_add("index_lookup_join_const", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND o_orderstatus = 'F'")
_add("theta_join", "SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey < n_nationkey")
_add("equi_plus_theta", "SELECT l_orderkey, l_partkey FROM lineitem, part WHERE l_partkey = p_partkey AND l_extendedprice < p_retailprice")
_add("multi_key_join", "SELECT COUNT(*) AS n FROM lineitem, supplier, orders WHERE l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND o_custkey = s_suppkey")
# aggregates
_add("count_star", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity < 10")
_add("count_col", "SELECT COUNT(o_orderstatus) AS n FROM orders")
_add("count_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS n FROM lineitem")
_add("sum_int", "SELECT SUM(l_linenumber) AS total FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem")
_add("sum_double", "SELECT SUM(o_totalprice) AS total FROM orders", "SELECT round(SUM(o_totalprice), 2) AS total FROM orders", rounded=("total",))
_add("sum_empty", "SELECT SUM(l_linenumber) AS total FROM lineitem WHERE l_orderkey < 0", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_orderkey < 0")
_add("count_empty", "SELECT COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS d FROM lineitem WHERE l_orderkey < 0")
_add("multi_agg", "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS d, SUM(o_totalprice) AS total FROM orders", "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS d, round(SUM(o_totalprice), 2) AS total FROM orders", rounded=("total",))
_add("agg_limit", "SELECT COUNT(*) AS n FROM orders LIMIT 0")
# order and limit
_add("order_asc", "SELECT n_name FROM nation ORDER BY n_name")
_add("order_desc", "SELECT n_name FROM nation ORDER BY n_name DESC")
_add("order_multi", "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey ASC")
_add("order_nonprojected", "SELECT s_name FROM supplier ORDER BY s_acctbal, s_suppkey")
_add("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_add("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
# what only standard mode has
_add("group_by", "SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey", rounded=("total",))
_add("group_by_join", "SELECT n_name, COUNT(DISTINCT c_mktsegment) AS segments FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name")
_add("distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
_add("offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
# order-processing shapes
_add("customer_by_name", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' ORDER BY c_name")
_add("oldest_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey ASC LIMIT 1")
_add("newest_order", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 1")
_add("order_lines", "SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey = 7")
_add("order_total", "SELECT SUM(l_extendedprice) AS ol_total FROM lineitem WHERE l_orderkey = 7", "SELECT round(SUM(l_extendedprice), 2) AS ol_total FROM lineitem WHERE l_orderkey = 7", rounded=("ol_total",))
_add("point_for_update", "SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey = 3 FOR UPDATE", "SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey = 3")
# compat mode agrees where there are no nulls
_add("compat_count", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS total FROM lineitem, orders WHERE l_orderkey = o_orderkey", "SELECT CAST(COUNT(*) AS INTEGER) AS n, CAST(SUM(l_linenumber) AS INTEGER) AS total FROM lineitem, orders WHERE l_orderkey = o_orderkey", mode=COMPAT)
# mutations
_change("insert_then_read", "INSERT INTO nation VALUES (100, 'ATLANTIS', 1), (101, 'MU', 2)", "SELECT * FROM nation UNION ALL VALUES (100, 'ATLANTIS', 1), (101, 'MU', 2)")
_change("insert_partial_null", "INSERT INTO supplier (s_suppkey, s_name) VALUES (1000000, 'new')", "SELECT * FROM supplier UNION ALL SELECT 1000000, 'new', NULL, NULL")
_change("delete_where", "DELETE FROM supplier WHERE s_nationkey >= 5 AND s_nationkey < 20", "SELECT * FROM supplier WHERE NOT (s_nationkey >= 5 AND s_nationkey < 20)")
_change("delete_all", "DELETE FROM region", "SELECT * FROM region WHERE false")
_change("update_literal", "UPDATE nation SET n_name = 'X', n_regionkey = 4 WHERE n_nationkey < 3", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 3 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation")
_change("update_plus", "UPDATE supplier SET s_acctbal = s_acctbal + 2.5, s_nationkey = s_nationkey + 1 WHERE s_nationkey = 3", "SELECT s_suppkey, s_name, CAST(CASE WHEN s_nationkey = 3 THEN s_nationkey + 1 ELSE s_nationkey END AS INTEGER) AS s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 2.5::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier")
_change("update_minus", "UPDATE supplier SET s_acctbal = s_acctbal - 1.25", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal - 1.25::DOUBLE AS s_acctbal FROM supplier")


def _session(spark: SparkSession, folder: str, *tables: tuple[str, list[str]]) -> Session:
    """A session on a catalogue of its own, in the shared folder, with copies of ``tables`` (name, key) of the folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    db = Session(spark, f"{shared}/tessera-catalogue/{uuid.uuid4().hex}")
    atexit.register(_drop, db)
    for name, key in tables:
        df = Files(spark, folder)[name]
        db.catalog.create(name, df.schema, key)
        db.catalog.append(name, df)
    return db


def _drop(db: Session) -> None:
    try:
        for name in db.catalog.names():
            db.catalog.drop(name)
    except Exception:  # noqa: BLE001  the session is gone already; the folder's owner cleans up
        pass


def _unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that INSERT refuses, of three, into a copy of supplier with a unique key."""
    db, refused = _session(spark, folder, ("supplier", ["s_suppkey"])), []
    for k in (3, 7, 10_000_000):
        try:
            db.execute("INSERT INTO supplier (s_suppkey, s_name) VALUES (?, 'new')", [k])
        except SqlError:
            refused.append((k,))
    return spark.createDataFrame(refused, "s_suppkey bigint")


def _statements(table: str, key: list[str], *texts: str):
    """The table after the statements, each a commit of its own, on a copy with a unique key."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        db = _session(spark, folder, (table, key))
        for text in texts:
            db.execute(text)
        return db.table(table)

    return run


QUERIES["table_statements"] = _statements("supplier", ["s_suppkey"], "INSERT INTO supplier VALUES (1000000, 'new', 3, 1.5), (1000001, 'newer', 4, 2.5)", "UPDATE supplier SET s_acctbal = s_acctbal + 2.5, s_nationkey = s_nationkey + 1 WHERE s_suppkey >= 1000000", "DELETE FROM supplier WHERE s_nationkey = 7")
ORACLES["table_statements"] = "SELECT * FROM supplier WHERE s_nationkey <> 7 UNION ALL VALUES (1000000, 'new', 4, 4.0::DOUBLE), (1000001, 'newer', 5, 5.0::DOUBLE)"
QUERIES["table_index_read"] = lambda spark, folder: _session(spark, folder, ("customer", ["c_custkey"])).execute("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 20 AND 40 > c_custkey").df
ORACLES["table_index_read"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 20 AND 40 > c_custkey"
QUERIES["insert_unique_violation"] = _unique_violations
ORACLES["insert_unique_violation"] = "SELECT CAST(k AS BIGINT) AS s_suppkey FROM (VALUES (3), (7), (10000000)) v(k) WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k)"

_GRID = [(a, b) for a in (None, 1, 2) for b in (None, 1, 2)]
_RULES = {
    "=": "a IS NOT DISTINCT FROM b",
    ">": "a IS NOT NULL AND (b IS NULL OR a > b)",
    ">=": "b IS NULL OR (a IS NOT NULL AND a >= b)",
    "<": "b IS NOT NULL AND (a IS NULL OR a < b)",
    "<=": "a IS NULL OR (b IS NOT NULL AND a <= b)",
}
for _op, _word in (("=", "eq"), (">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le")):
    QUERIES[f"null_order_{_word}"] = lambda spark, _, op=_op: spark.createDataFrame(_GRID, "a int, b int").where(compare(F.col("a"), op, F.col("b"), COMPAT))
    ORACLES[f"null_order_{_word}"] = f"SELECT * FROM (VALUES {', '.join(f'({a or "NULL"}::INTEGER, {b or "NULL"}::INTEGER)' for a, b in _GRID)}) v(a, b) WHERE {_RULES[_op]}"

for _rule, _args in (("gather", {}), ("round_robin", {"consumers": 4}), ("broadcast", {})):
    QUERIES[f"exchange_{_rule}"] = lambda spark, folder, rule=_rule, args=_args: exchange(Files(spark, folder)["orders"].select("o_orderkey", "o_custkey"), rule, **args)
    ORACLES[f"exchange_{_rule}"] = "SELECT o_orderkey, o_custkey FROM orders"
# how many tasks hold rows of a customer: one, if equal keys meet
QUERIES["exchange_hash"] = lambda spark, folder: exchange(Files(spark, folder)["orders"].select("o_custkey"), "hash", 4, "o_custkey").select("o_custkey", F.spark_partition_id().alias("task")).groupBy("o_custkey").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("n"))
ORACLES["exchange_hash"] = "SELECT o_custkey, CAST(1 AS BIGINT) AS tasks, COUNT(*) AS n FROM orders GROUP BY o_custkey"
