import json

import pytest
from helpers import SF
from grainline import verify
from grainline.catalog import loads
from grainline.operators import audit
from grainline.plans import star
from grainline.plans.planner import Request
from test_catalog import BASE


def test_static():
    assert verify.static(loads(BASE)).passed
    cases = {"status: deprecated, replaced_by: e": "catalog.deprecation.replacement_missing", "status: deprecated, replaced_by: d": "catalog.deprecation.self_replacement", "status: deprecated, replaced_by: m": "catalog.deprecation.replacement_kind"}
    for text, code in cases.items():
        report = verify.static(loads(BASE.replace("d: {source", f"d: {{{text}, source")))
        assert not report.passed and code in {d.code for d in report.diagnostics}
    cycle = BASE.replace("  d: {source: s,", "  e: {status: deprecated, replaced_by: d, source: s, column: t, data_type: string}\n  d: {status: deprecated, replaced_by: e, source: s,")
    assert "catalog.deprecation.cycle" in {d.code for d in verify.static(loads(cycle)).diagnostics}


def test_one_way_to_all_checks(spark):
    assert verify.verify(loads(BASE), verify.StaticCheck()) == verify.static(loads(BASE))
    case = Request.of(["quantity"], ["none"])
    assert verify.verify(star.layer(SF), verify.CompatibilityCheck((case,))) == verify.compatibility(star.layer(SF), [case])
    assert not verify.verify(loads(BASE), verify.PhysicalCheck(spark)).complete
    with pytest.raises(TypeError):
        verify.verify(loads(BASE), "static")


def test_compatibility():
    report = verify.compatibility(star.layer(SF), [Request.of(["quantity"], ["none"])])
    assert report.passed
    by = {o.check_id: o.evidence for o in report.outcomes}
    assert by["compatibility.metric_dimension.order_total.return_flag"]["planner_code"] == "row_expanding_path"
    assert by["compatibility.metric_dimension.quantity.brand"]["relationship_ids"] == ["line_parts"]
    assert by["compatibility.explicit.0000"] == {"compatible": False, "planner_code": "unknown_dimension", "message": "request references an unknown dimension"}
    json.loads(report.to_json())


def test_physical(spark):
    report = verify.physical(star.layer(SF), spark)
    by = {o.check_id: o for o in report.outcomes}
    assert by["source.lineitem.grain"].status == "passed" and by["source.lineitem.grain"].evidence["row_count"] == 6000
    assert by["relationship.document_labels.cardinality"].status == "failed"  # labels cover some documents only
    assert by["relationship.order_lines.cardinality"].evidence["orphan_non_null_rows"] == 0
    assert SF not in report.to_json()


def test_counts_with_nulls_and_duplicates(spark):
    one = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,), (3,)], "k int")
    many = spark.createDataFrame([(None,), (1,), (1,), (1,), (9,), (3,)], "k int")
    assert audit.directed(one, "k", many, "k").first().asDict() == {
        "one_side_null_rows": 2, "one_side_duplicate_groups": 2, "many_side_null_rows": 1, "orphan_non_null_rows": 1, "zero_child_one_side_rows": 3, "maximum_child_multiplicity": 3,
    }
    empty = one.limit(0)
    assert set(audit.directed(empty, "k", empty, "k").first()) == {0}
    assert audit.grain(one, ["k"]).first().asDict() == {"row_count": 6, "distinct_grain_count": 4, "duplicate_row_count": 2, "null_grain_rows": 2, "duplicate_grain_groups": 2}
    assert audit.one_to_one(one, "k", many, "k").first().asDict() == {
        "source_null_rows": 2, "source_duplicate_groups": 2, "target_null_rows": 1, "target_duplicate_groups": 1, "source_unmatched_non_null_rows": 1, "target_unmatched_non_null_rows": 1,
    }
