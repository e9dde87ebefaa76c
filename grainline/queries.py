"""The registered queries of the engine and their DuckDB twins, written on the raw tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainline.operators import audit, profile
from grainline.plans import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SALT = "star"
_engines: dict[tuple[str, str], Any] = {}


def engine(spark: SparkSession, sf_dir: str):
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = star.engine(spark, sf_dir)
    return _engines[key]


#: Columns of small numbers.
FINE = ("average_discount", "return_rate", "margin", "good_share", "taxed", "average_price", "average_value")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to two digits, and shares and averages to six: sums of doubles depend on the order of rows."""
    return df.select(*[F.round(f"`{f.name}`", 6 if f.name in FINE else 2).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def ask(name: str, sql: str, metrics: list[str], dimensions: list[str] | None = None, filters: dict | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(engine(spark, sf_dir).query(metrics, dimensions or [], filters))
    ORACLES[name] = sql


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LO = "lineitem JOIN orders ON o_orderkey = l_orderkey"
_LP = "lineitem JOIN part ON p_partkey = l_partkey"
ask("flagship", f"SELECT p_brand AS brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue, round(avg(l_discount), 6) AS average_discount FROM {_LP} JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1", ["net_revenue", "average_discount"], ["brand"], {"order_status": ["F", "O"]})
ask("dim_projection", "SELECT l_returnflag AS return_flag, count(l_quantity) AS lines FROM lineitem GROUP BY 1", ["lines"], ["return_flag"])
ask("fact_expr", "SELECT l_linestatus AS line_status, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue FROM lineitem GROUP BY 1", ["net_revenue"], ["line_status"])
ask("metric_ratio", "SELECT l_linenumber AS line_number, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / sum(l_quantity), 6) AS return_rate FROM lineitem GROUP BY 1", ["return_rate"], ["line_number"])
ask("alias_isolation", "SELECT o_orderstatus AS order_status, count(DISTINCT o_orderkey) AS segment FROM orders GROUP BY 1", ["segment"], ["order_status"])
ask("filter_scalar", "SELECT round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag = 'R'", ["quantity"], [], {"return_flag": "R"})
ask("filter_null", "SELECT count(l_quantity) AS lines FROM lineitem WHERE l_returnflag = NULL", ["lines"], [], {"return_flag": None})
ask("filter_in", "SELECT l_returnflag AS return_flag, count(l_quantity) AS lines FROM lineitem WHERE l_returnflag IN ('A', 'N', NULL) GROUP BY 1", ["lines"], ["return_flag"], {"return_flag": ["A", "N", None]})
ask("filter_in_empty", "SELECT l_returnflag AS return_flag, count(l_quantity) AS lines FROM lineitem WHERE FALSE GROUP BY 1", ["lines"], ["return_flag"], {"return_flag": []})
ask("filter_between", "SELECT o_orderpriority AS order_priority, count(DISTINCT o_orderkey) AS order_count FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1", ["order_count"], ["order_priority"], {"order_date": (datetime(1996, 1, 1), datetime(1997, 12, 31))})
ask("filter_multi", f"SELECT l_returnflag AS return_flag, round(sum(l_quantity), 2) AS quantity FROM {_LP} JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND p_size BETWEEN 5 AND 20 GROUP BY 1", ["quantity"], ["return_flag"], {"part_size": (5, 20), "order_status": "F"})
ask("filter_only_dim", "SELECT count(l_quantity) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'", ["lines"], [], {"segment": "BUILDING"})
ask("join_many_to_one", f"SELECT o_orderpriority AS order_priority, round(sum(l_quantity), 2) AS quantity FROM {_LO} GROUP BY 1", ["quantity"], ["order_priority"])
ask("join_chain", "SELECT r_name AS supplier_region, n_name AS supplier_nation, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2", ["quantity"], ["supplier_region", "supplier_nation"])
ask("join_shared_path", f"SELECT n_name AS customer_nation, c_mktsegment AS segment, o_orderstatus AS order_status, count(l_quantity) AS lines FROM {_LO} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3", ["lines"], ["customer_nation", "segment", "order_status"])
ask("join_one_to_one", "SELECT lang, round(sum(quality) / nullif(count(quality), 0), 6) AS good_share FROM labels JOIN documents USING (doc_id) GROUP BY 1", ["good_share"], ["lang"])
ask("join_one_to_one_back", "SELECT toxic, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1", ["chars"], ["toxic"])
ask("agg_sum", "SELECT event_type, round(sum(value), 2) AS event_value FROM events GROUP BY 1", ["event_value"], ["event_type"])
ask("agg_avg", "SELECT l_returnflag AS return_flag, round(avg(l_discount), 6) AS average_discount FROM lineitem GROUP BY 1", ["average_discount"], ["return_flag"])
ask("agg_min", "SELECT l_returnflag AS return_flag, min(l_quantity) AS least_quantity FROM lineitem GROUP BY 1", ["least_quantity"], ["return_flag"])
ask("agg_max", "SELECT o_orderstatus AS order_status, max(o_orderdate) AS last_order FROM orders GROUP BY 1", ["last_order"], ["order_status"])
ask("agg_count", "SELECT event_type, count(value) AS events FROM events GROUP BY 1", ["events"], ["event_type"])
ask("agg_count_distinct", f"SELECT p_brand AS brand, count(DISTINCT l_orderkey) AS orders_in_lines FROM {_LP} GROUP BY 1", ["orders_in_lines"], ["brand"])
ask("agg_conditional", "SELECT l_linestatus AS line_status, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS returned_quantity FROM lineitem GROUP BY 1", ["returned_quantity"], ["line_status"])
ask("group_multi_dim", f"SELECT l_returnflag AS return_flag, l_linestatus AS line_status, o_orderstatus AS order_status, count(l_quantity) AS lines FROM {_LO} GROUP BY 1, 2, 3", ["lines"], ["return_flag", "line_status", "order_status"])
ask("global_agg", "SELECT count(l_quantity) AS lines, count(DISTINCT l_orderkey) AS orders_in_lines FROM lineitem", ["lines", "orders_in_lines"])
ask("global_agg_empty", "SELECT round(sum(l_quantity), 2) AS quantity, count(l_quantity) AS lines, count(DISTINCT l_orderkey) AS orders_in_lines FROM lineitem WHERE l_returnflag = 'none'", ["quantity", "lines", "orders_in_lines"], [], {"return_flag": "none"})
ask("multi_metric", f"SELECT o_orderstatus AS order_status, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS average_discount, max(l_quantity) AS most_quantity, count(DISTINCT CASE WHEN o_totalprice > 200000.5 THEN l_orderkey END) AS big_orders FROM {_LO} GROUP BY 1", ["net_revenue", "quantity", "average_discount", "most_quantity", "big_orders"], ["order_status"])
ask("metric_aov", "SELECT c_mktsegment AS segment, round(sum(o_totalprice) / nullif(count(DISTINCT o_orderkey), 0), 2) AS average_order_value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", ["average_order_value"], ["segment"])
ask("metric_margin", f"SELECT p_brand AS brand, round((sum(l_extendedprice * (1 - l_discount)) - sum(l_quantity * p_retailprice)) / nullif(sum(l_extendedprice * (1 - l_discount)), 0), 6) AS margin FROM {_LP} GROUP BY 1", ["margin"], ["brand"])
ask("cross_source_fact", f"SELECT l_returnflag AS return_flag, round(sum(l_quantity * p_retailprice), 2) AS retail_value FROM {_LP} GROUP BY 1", ["retail_value"], ["return_flag"])
ask("expr_arith", "SELECT l_returnflag AS return_flag, round(sum(l_quantity * 2 - l_tax + 1.5), 2) AS arithmetic FROM lineitem GROUP BY 1", ["arithmetic"], ["return_flag"])
ask("expr_div", "SELECT l_returnflag AS return_flag, round(avg(l_extendedprice / l_quantity), 2) AS per_unit, round(sum(l_linenumber / 2), 2) AS linenumber_half FROM lineitem GROUP BY 1", ["per_unit", "linenumber_half"], ["return_flag"])
ask("expr_unary", "SELECT l_returnflag AS return_flag, round(sum(-l_discount + l_tax), 2) AS negated, sum(CASE WHEN NOT (l_returnflag = 'R') THEN l_linenumber ELSE 0 END)::BIGINT AS not_returned FROM lineitem GROUP BY 1", ["negated", "not_returned"], ["return_flag"])
ask("expr_compare", "SELECT l_linestatus AS line_status, sum(CASE WHEN l_quantity >= 25 THEN l_linenumber ELSE 0 END)::BIGINT AS at_least_25, sum(CASE WHEN l_linenumber <> 1 THEN 0 ELSE 1 END)::BIGINT AS early_line FROM lineitem GROUP BY 1", ["at_least_25", "early_line"], ["line_status"])
ask("expr_literals", "SELECT l_returnflag AS return_flag, min(CASE WHEN l_returnflag = 'A' THEN 'it''s' ELSE 'no' END) AS literals FROM lineitem GROUP BY 1", ["literals"], ["return_flag"])
ask("fn_abs", "SELECT l_returnflag AS return_flag, round(sum(abs(l_quantity - 25)), 2) AS distance FROM lineitem GROUP BY 1", ["distance"], ["return_flag"])
ask("fn_coalesce", "SELECT l_returnflag AS return_flag, round(avg(coalesce(nullif(l_tax, 0), 0.5)), 6) AS taxed FROM lineitem GROUP BY 1", ["taxed"], ["return_flag"])
ask("fn_nullif", "SELECT l_returnflag AS return_flag, count(nullif(l_discount, 0)) AS nonzero_discount FROM lineitem GROUP BY 1", ["nonzero_discount"], ["return_flag"])
ask("fn_if", f"SELECT l_returnflag AS return_flag, count(DISTINCT CASE WHEN o_totalprice > 200000.5 THEN l_orderkey END) AS big_orders FROM {_LO} GROUP BY 1", ["big_orders"], ["return_flag"])
ask("fn_lower", "SELECT l_returnflag AS return_flag, max(lower(l_linestatus)) AS status_lower FROM lineitem GROUP BY 1", ["status_lower"], ["return_flag"])
ask("fn_upper", "SELECT event_type, min(upper(event_type)) AS type_upper FROM events GROUP BY 1", ["type_upper"], ["event_type"])


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).registry.read("nation")


@register("SELECT o_orderkey, o_orderstatus FROM orders")
def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scan("orders", ["o_orderkey", "o_orderstatus"]).frame()


@register("SELECT count(*) AS row_count, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_grain_count, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_row_count, count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_grain_rows, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_grain_groups FROM lineitem")
def audit_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.grain(engine(spark, sf_dir).registry.read("lineitem"), ("l_orderkey", "l_linenumber"))


@register("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def audit_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_groups(engine(spark, sf_dir).registry.read("lineitem"), ("l_orderkey", "l_linenumber"))


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [engine(spark, sf_dir).registry.read(n) for n in names]


@register("SELECT event_id, user_id FROM events WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)")
def audit_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, customer = _read(spark, sf_dir, "events", "customer")
    return audit.orphans(events, "user_id", customer, "c_custkey").select("event_id", "user_id")


@register("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def audit_zero_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _read(spark, sf_dir, "orders", "lineitem")
    return audit.childless(orders, "o_orderkey", lines, "l_orderkey").select("o_orderkey")


_DIRECTED = """SELECT (SELECT count(*) FROM {one} WHERE {ok} IS NULL) AS one_side_null_rows, (SELECT count(*) FROM (SELECT 1 FROM {one} GROUP BY {ok} HAVING count(*) > 1)) AS one_side_duplicate_groups,
(SELECT count(*) FROM {many} WHERE {mk} IS NULL) AS many_side_null_rows, (SELECT count(*) FROM {many} WHERE {mk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {one} WHERE {ok} = {mk})) AS orphan_non_null_rows,
(SELECT count(*) FROM {one} WHERE NOT EXISTS (SELECT 1 FROM {many} WHERE {mk} = {ok})) AS zero_child_one_side_rows,
(SELECT coalesce(max(n), 0) FROM (SELECT count({mk}) AS n FROM (SELECT DISTINCT {ok} FROM {one}) LEFT JOIN {many} ON {mk} = {ok} GROUP BY {ok})) AS maximum_child_multiplicity"""


@register(_DIRECTED.format(one="orders", ok="o_orderkey", many="lineitem", mk="l_orderkey"))
def audit_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _read(spark, sf_dir, "orders", "lineitem")
    return audit.directed(orders, "o_orderkey", lines, "l_orderkey")


@register("SELECT coalesce(max(n), 0) AS maximum_child_multiplicity FROM (SELECT count(user_id) AS n FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey)")
def audit_max_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, events = _read(spark, sf_dir, "customer", "events")
    return audit.directed(customer, "c_custkey", events, "user_id").select("maximum_child_multiplicity")


_ONE = """SELECT (SELECT count(*) FROM labels WHERE doc_id IS NULL) AS source_null_rows, (SELECT count(*) FROM (SELECT 1 FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS source_duplicate_groups,
(SELECT count(*) FROM documents WHERE doc_id IS NULL) AS target_null_rows, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS target_duplicate_groups,
(SELECT count(*) FROM labels l WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS source_unmatched_non_null_rows,
(SELECT count(*) FROM documents d WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)) AS target_unmatched_non_null_rows"""


@register(_ONE)
def audit_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, documents = _read(spark, sf_dir, "labels", "documents")
    return audit.one_to_one(labels, "doc_id", documents, "doc_id")


@register("SELECT (SELECT count(*) FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = l_partkey)) AS source_unmatched_non_null_rows, (SELECT count(*) FROM events WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE user_id = l_partkey)) AS target_unmatched_non_null_rows")
def audit_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, events = _read(spark, sf_dir, "lineitem", "events")
    return audit.many_to_many(lines, "l_partkey", events, "user_id")


@register("\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, {f'min({c})::VARCHAR' if r else 'NULL::VARCHAR'} AS min_value, {f'max({c})::VARCHAR' if r else 'NULL::VARCHAR'} AS max_value FROM orders" for c, r in (("o_orderkey", 1), ("o_custkey", 1), ("o_orderstatus", 0), ("o_totalprice", 1), ("o_orderdate", 1), ("o_orderpriority", 0))))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.columns(engine(spark, sf_dir).registry.read("orders"))


@register("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)) AS duplicate_rows FROM lineitem")
def profile_grain_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = _read(spark, sf_dir, "lineitem")
    return audit.grain(lines, ("l_orderkey", "l_partkey", "l_suppkey")).select(F.col("duplicate_row_count").alias("duplicate_rows"))


@register(f"SELECT c_custkey, c_name, sha256('{SALT}' || chr(31) || 'customer' || chr(31) || c_custkey) AS row_key FROM customer ORDER BY row_key LIMIT 20")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customer,) = _read(spark, sf_dir, "customer")
    return profile.sample(customer, "customer", ("c_custkey",), SALT).select("c_custkey", "c_name", "row_key")


@register(f"SELECT sha256('{SALT}' || chr(31) || 'c_name' || chr(31) || c_name) AS c_name, CASE WHEN c_mktsegment IS NOT NULL THEN 'non_null' END AS c_mktsegment, c_custkey FROM customer")
def transform_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customer,) = _read(spark, sf_dir, "customer")
    return profile.redacted(customer, {"c_name": "hash", "c_mktsegment": "redact", "c_custkey": "reveal"}, SALT)


@register("""SELECT CASE WHEN r <= 0.25 THEN 'b0' WHEN r <= 0.5 THEN 'b1' WHEN r <= 0.75 THEN 'b2' ELSE 'b3' END AS o_totalprice, CASE WHEN o_orderdate IS NOT NULL THEN 'bucketed' END AS o_orderdate, o_orderkey
FROM (SELECT *, (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) AS r FROM orders)""")
def transform_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _read(spark, sf_dir, "orders")
    return profile.redacted(orders, {"o_totalprice": "bucket", "o_orderdate": "bucket", "o_orderkey": "reveal"}, SALT)


@register(f"""SELECT row_key, CASE WHEN r <= 0.25 THEN 'b0' WHEN r <= 0.5 THEN 'b1' WHEN r <= 0.75 THEN 'b2' ELSE 'b3' END AS c_acctbal, sha256('{SALT}' || chr(31) || 'c_name' || chr(31) || c_name) AS c_name, c_mktsegment
FROM (SELECT *, sha256('{SALT}' || chr(31) || 'customer' || chr(31) || c_custkey) AS row_key, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS r FROM customer) ORDER BY row_key LIMIT 20""")
def context_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customer,) = _read(spark, sf_dir, "customer")
    policy = profile.Policy("customer", ("c_custkey",), {"c_acctbal": "bucket", "c_name": "hash", "c_mktsegment": "reveal"})
    return profile.sampled(customer, policy, SALT)


@register(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '-----BEGIN(?: |\r?\n)[A-Z0-9 ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36}\b|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b')")
def hard_deny_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = _read(spark, sf_dir, "documents")
    return documents.where(profile.denied(F.col("text"))).select("doc_id")


@register("SELECT 'customer' AS source, 2 AS generation, count(*) AS rows FROM customer UNION ALL SELECT 'orders', 2, count(*) FROM orders")
def reload_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = star.engine(spark, sf_dir)
    fresh.registry.reload("customer", "orders")
    parts = [fresh.registry.read(s).agg(F.lit(s).alias("source"), F.lit(fresh.registry.status(s).generation).alias("generation"), F.count(F.lit(1)).alias("rows")) for s in ("customer", "orders")]
    return parts[0].union(parts[1])
