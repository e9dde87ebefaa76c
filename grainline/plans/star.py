"""A catalog over the star-schema test tables, and an engine on it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from grainline.catalog import loads
from grainline.engine import SemanticEngine
from grainline.model import SemanticLayer

_TABLES = {
    "region": ("region", "r_regionkey! int32, r_name utf8", "r_regionkey"),
    "nation": ("nation", "n_nationkey! int32, n_name utf8, n_regionkey int32", "n_nationkey"),
    "customer_nation": ("nation", "n_nationkey! int32, n_name utf8, n_regionkey int32", "n_nationkey"),
    "customer": ("customer", "c_custkey! int64, c_name utf8, c_nationkey int32, c_acctbal float64, c_mktsegment utf8", "c_custkey"),
    "supplier": ("supplier", "s_suppkey! int64, s_name utf8, s_nationkey int32, s_acctbal float64", "s_suppkey"),
    "part": ("part", "p_partkey! int64, p_name utf8, p_brand utf8, p_type utf8, p_size int32, p_retailprice float64", "p_partkey"),
    "orders": ("orders", "o_orderkey! int64, o_custkey int64, o_orderstatus utf8, o_totalprice float64, o_orderdate ts, o_orderpriority utf8", "o_orderkey"),
    "lineitem": (
        "lineitem",
        "l_orderkey! int64, l_partkey! int64, l_suppkey! int64, l_linenumber! int32, l_quantity float64, l_extendedprice float64, l_discount float64, l_tax float64, l_returnflag utf8, l_linestatus utf8, l_shipdate! ts",
        "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate",
    ),
    "events": ("events", "event_id! int64, ts ts, user_id int64, event_type utf8, value float64, props utf8", "event_id"),
    "documents": ("documents", "doc_id! int64, text utf8, lang utf8, source utf8, n_chars int64", "doc_id"),
    "labels": ("labels", "doc_id! int64, quality int32, toxic int32", "doc_id"),
}


def _source(sf_dir: str, name: str) -> str:
    table, fields, grain = _TABLES[name]
    lines = []
    for f in fields.split(", "):
        column, kind = f.split(" ")
        kind = "{timestamp: {unit: us}}" if kind == "ts" else kind
        lines.append(f"{{name: {column.rstrip('!')}, type: {kind}, nullable: {str(not column.endswith('!')).lower()}}}")
    return f"  {name}: {{type: parquet, location: '{sf_dir}/{table}.parquet', nullability: declared, grain: [{grain}], schema: {{fields: [{', '.join(lines)}]}}}}"


SEMANTICS = """
dimensions:
  brand: {source: part, column: p_brand, data_type: string}
  part_size: {source: part, column: p_size, data_type: integer}
  order_status: {source: orders, column: o_orderstatus, data_type: string}
  order_priority: {source: orders, column: o_orderpriority, data_type: string}
  order_date: {source: orders, column: o_orderdate, data_type: timestamp}
  return_flag: {source: lineitem, column: l_returnflag, data_type: string}
  line_status: {source: lineitem, column: l_linestatus, data_type: string}
  line_number: {source: lineitem, column: l_linenumber, data_type: integer}
  segment: {source: customer, column: c_mktsegment, data_type: string}
  customer_nation: {source: customer_nation, column: n_name, data_type: string}
  supplier_nation: {source: nation, column: n_name, data_type: string}
  supplier_region: {source: region, column: r_name, data_type: string}
  event_type: {source: events, column: event_type, data_type: string}
  toxic: {source: labels, column: toxic, data_type: integer}
  lang: {source: documents, column: lang, data_type: string}
facts:
  net_revenue: {source: lineitem, data_type: double, expression: lineitem.l_extendedprice * (1 - lineitem.l_discount)}
  extended_price: {source: lineitem, data_type: double, expression: lineitem.l_extendedprice}
  quantity: {source: lineitem, data_type: double, expression: lineitem.l_quantity}
  discount: {source: lineitem, data_type: double, expression: lineitem.l_discount}
  returned_quantity: {source: lineitem, data_type: double, expression: "if(lineitem.l_returnflag = 'R', lineitem.l_quantity, null)"}
  retail_value: {source: lineitem, data_type: double, expression: lineitem.l_quantity * part.p_retailprice}
  line_order: {source: lineitem, data_type: integer, expression: lineitem.l_orderkey}
  big_order: {source: lineitem, data_type: integer, expression: "if(orders.o_totalprice > 200000.5, lineitem.l_orderkey, null)"}
  arithmetic: {source: lineitem, data_type: double, expression: lineitem.l_quantity * 2 - lineitem.l_tax + 1.5}
  per_unit: {source: lineitem, data_type: double, expression: lineitem.l_extendedprice / lineitem.l_quantity}
  linenumber_half: {source: lineitem, data_type: integer, expression: lineitem.l_linenumber / 2}
  negated: {source: lineitem, data_type: double, expression: -lineitem.l_discount + +lineitem.l_tax}
  not_returned: {source: lineitem, data_type: integer, expression: "if(not (lineitem.l_returnflag = 'R'), lineitem.l_linenumber, 0)"}
  at_least_25: {source: lineitem, data_type: integer, expression: "if(lineitem.l_quantity >= 25, lineitem.l_linenumber, 0)"}
  early_line: {source: lineitem, data_type: integer, expression: "if(lineitem.l_linenumber != 1, 0, 1)"}
  literals: {source: lineitem, data_type: string, expression: "if(lineitem.l_returnflag = 'A', 'it\\\\'s', coalesce(null, 'no'))"}
  distance: {source: lineitem, data_type: double, expression: abs(lineitem.l_quantity - 25)}
  taxed: {source: lineitem, data_type: double, expression: "coalesce(nullif(lineitem.l_tax, 0), 0.5)"}
  nonzero_discount: {source: lineitem, data_type: double, expression: "nullif(lineitem.l_discount, 0)"}
  status_lower: {source: lineitem, data_type: string, expression: lower(lineitem.l_linestatus)}
  type_upper: {source: events, data_type: string, expression: upper(events.event_type)}
  order_total: {source: orders, data_type: double, expression: orders.o_totalprice}
  order_id: {source: orders, data_type: integer, expression: orders.o_orderkey}
  order_day: {source: orders, data_type: timestamp, expression: orders.o_orderdate}
  event_value: {source: events, data_type: double, expression: events.value}
  quality: {source: labels, data_type: integer, expression: labels.quality}
  size_chars: {source: documents, data_type: integer, expression: documents.n_chars}
measures:
  net_revenue: {fact: net_revenue, aggregation: sum}
  extended_price: {fact: extended_price, aggregation: sum}
  quantity: {fact: quantity, aggregation: sum}
  average_discount: {fact: discount, aggregation: avg}
  least_quantity: {fact: quantity, aggregation: min}
  most_quantity: {fact: quantity, aggregation: max}
  lines: {fact: quantity, aggregation: count}
  orders_in_lines: {fact: line_order, aggregation: count_distinct}
  big_orders: {fact: big_order, aggregation: count_distinct}
  returned_quantity: {fact: returned_quantity, aggregation: sum}
  retail_value: {fact: retail_value, aggregation: sum}
  arithmetic: {fact: arithmetic, aggregation: sum}
  per_unit: {fact: per_unit, aggregation: avg}
  linenumber_half: {fact: linenumber_half, aggregation: sum}
  negated: {fact: negated, aggregation: sum}
  not_returned: {fact: not_returned, aggregation: sum}
  at_least_25: {fact: at_least_25, aggregation: sum}
  early_line: {fact: early_line, aggregation: sum}
  literals: {fact: literals, aggregation: min}
  distance: {fact: distance, aggregation: sum}
  taxed: {fact: taxed, aggregation: avg}
  nonzero_discount: {fact: nonzero_discount, aggregation: count}
  status_lower: {fact: status_lower, aggregation: max}
  type_upper: {fact: type_upper, aggregation: min}
  order_total: {fact: order_total, aggregation: sum}
  order_count: {fact: order_id, aggregation: count_distinct}
  last_order: {fact: order_day, aggregation: max}
  event_value: {fact: event_value, aggregation: sum}
  events: {fact: event_value, aggregation: count}
  good: {fact: quality, aggregation: sum}
  labelled: {fact: quality, aggregation: count}
  chars: {fact: size_chars, aggregation: sum}
metrics:
MEASURES
  average_order_value: {expression: "order_total / nullif(order_count, 0)", measures: [order_total, order_count]}
  margin: {expression: "(net_revenue - retail_value) / nullif(net_revenue, 0)", measures: [net_revenue, retail_value]}
  return_rate: {expression: returned_quantity / quantity, measures: [returned_quantity, quantity]}
  good_share: {expression: "good / nullif(labelled, 0)", measures: [good, labelled]}
  segment: {expression: order_count, measures: [order_count]}
relationships:
  region_nations: {source: region, target: nation, type: one_to_many, source_column: r_regionkey, target_column: n_regionkey}
  nation_suppliers: {source: nation, target: supplier, type: one_to_many, source_column: n_nationkey, target_column: s_nationkey}
  nation_customers: {source: customer_nation, target: customer, type: one_to_many, source_column: n_nationkey, target_column: c_nationkey}
  customer_orders: {source: customer, target: orders, type: one_to_many, source_column: c_custkey, target_column: o_custkey}
  order_lines: {source: orders, target: lineitem, type: one_to_many, source_column: o_orderkey, target_column: l_orderkey}
  line_parts: {source: lineitem, target: part, type: many_to_one, source_column: l_partkey, target_column: p_partkey}
  supplier_lines: {source: supplier, target: lineitem, type: one_to_many, source_column: s_suppkey, target_column: l_suppkey}
  customer_events: {source: customer, target: events, type: one_to_many, source_column: c_custkey, target_column: user_id}
  document_labels: {source: labels, target: documents, type: one_to_one, source_column: doc_id, target_column: doc_id}
"""


def layer(sf_dir: str, sources: tuple[str, ...] | None = None) -> SemanticLayer:
    """The catalog over a folder of tables."""
    measures = [line.split(":")[0].strip() for line in SEMANTICS.split("measures:\n")[1].split("metrics:\n")[0].splitlines()]
    plain = "\n".join(f"  {m}: {{expression: {m}, measures: [{m}]}}" for m in measures)
    text = "version: 1\nname: star\ndata_sources:\n" + "\n".join(_source(sf_dir, s) for s in sources or _TABLES) + SEMANTICS.replace("MEASURES", plain)
    return loads(text)


def engine(spark: SparkSession, sf_dir: str) -> SemanticEngine:
    return SemanticEngine(layer(sf_dir), spark)
