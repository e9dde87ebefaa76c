import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import SF, same
from grainline import queries
from grainline.errors import PlanningError, QueryError
from grainline.functions.columns import column
from grainline.functions.dsl import parse
from grainline.plans import star


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def test_every_metric_with_every_dimension(spark):
    """Each pair plans, or is refused with a code; a sample of those that plan runs, and groups add up."""
    engine, good = queries.engine(spark, SF), []
    for m in engine.layer.metrics:
        for d in engine.layer.dimensions:
            try:
                engine.plan([m], [d])
                good.append((m, d))
            except PlanningError as error:
                assert error.code in ("row_expanding_path", "no_relationship_path", "duplicate_output_name")
    assert len(good) > 200
    for m, d in random.Random(1).sample(good, 12):
        assert engine.query([m], [d]).columns == [d, m]
    by, total = engine.run(["lines"], ["brand"]), engine.run(["lines"])
    assert by["lines"].sum() == total["lines"][0]


def test_pushdown_and_pruning(spark):
    plan = queries.engine(spark, SF).query(["quantity"], ["return_flag"], {"return_flag": "R"})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    assert "Python" not in plan


@pytest.mark.parametrize(("a", "b", "expected"), [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (0.0, 0.0, math.nan), (math.nan, 0.0, math.nan), (None, 0.0, None), (1.0, None, None), (7.0, 2.0, 3.5)])
def test_division_by_ieee_rules(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "x double, y double")
    got = df.select(column(parse("t.x / t.y"), lambda p: F.col(p[1])).alias("q")).first()["q"]
    assert got == expected or (got is not None and expected is not None and math.isnan(got) and math.isnan(expected))


def test_failures_say_a_category_only(spark, tmp_path):
    spark.createDataFrame([(2**62, "secret-value"), (2**62, "x")], "id long, s string").write.parquet(str(tmp_path / "t.parquet"))
    from grainline.catalog import loads
    from grainline.engine import SemanticEngine

    layer = loads(f"version: 1\nname: x\ndata_sources:\n  t: {{type: parquet, location: '{tmp_path}/t.parquet', nullability: declared, grain: [id], schema: {{fields: [{{name: id, type: int64, nullable: false}}, {{name: s, type: utf8}}]}}}}\nfacts:\n  i: {{source: t, data_type: integer, expression: t.id}}\nmeasures:\n  i: {{fact: i, aggregation: sum}}\nmetrics:\n  i: {{expression: i, measures: [i]}}\n")
    with pytest.raises(QueryError) as error:
        SemanticEngine(layer, spark).run(["i"])
    assert error.value.category == "arithmetic"
    assert "secret" not in str(error.value) and str(tmp_path) not in str(error.value)


def test_star_catalog_loads():
    assert star.layer(SF).relationships["order_lines"].expands("orders")
