import pytest

from grainline.catalog import load, loads
from grainline.errors import CatalogError

BASE = """
version: 1
name: test
data_sources:
  s: {type: parquet, location: x, grain: [id], schema: {fields: [{name: id, type: int64, nullable: false}, {name: t, type: utf8}, {name: f, type: float64}]}}
  u: {type: parquet, location: x, grain: [id], schema: {fields: [{name: id, type: utf8, nullable: false}, {name: n, type: int64}]}}
dimensions:
  d: {source: s, column: t, data_type: string}
facts:
  f: {source: s, data_type: double, expression: s.f}
  t: {source: s, data_type: string, expression: s.t}
measures:
  m: {fact: f, aggregation: sum}
metrics:
  m: {expression: m, measures: [m]}
"""


def codes(text: str) -> set[str]:
    with pytest.raises(CatalogError) as error:
        loads(text)
    return {i.code for i in error.value.issues}


def test_good_catalog():
    found = loads(BASE)
    assert list(found.objects()) == sorted(found.objects())
    assert found.resolve("metric.m").measures == ("m",)
    with pytest.raises(KeyError):
        found.resolve("metric.none")


@pytest.mark.parametrize(
    ("old", "new", "code"),
    [
        ("version: 1", "version: 2", "catalog.version.unsupported"), ("version: 1", "version: true", "catalog.version.unsupported"), ("grain: [id], schema: {fields: [{name: id, type: int64, nullable: false}", "grain: [id, id], schema: {fields: [{name: id, type: int64, nullable: false}", "catalog.grain.duplicate_column"),
        ("type: int64, nullable: false", "type: int64", "catalog.grain.nullable_column"), ("column: t", "column: none", "catalog.invalid"), ("data_type: string}\nfacts", "data_type: integer}\nfacts", "catalog.invalid"),
        ("fact: f, aggregation: sum", "fact: t, aggregation: sum", "catalog.measure.invalid_aggregation_type"), ("aggregation: sum", "aggregation: median", "catalog.invalid"), ("measures: [m]", "measures: [m, x]", "catalog.invalid"),
        ("expression: m,", "expression: lower(m),", "catalog.invalid"), ("  d: {", "  D: {", "catalog.invalid"), ("location: x, grain", "location: x, password: y, grain", "catalog.invalid"), ("location: x,", "location: 's3://bucket/x',", "catalog.invalid"),
        ("name: test", "name: test\nname: again", "catalog.invalid"), ("d: {source: s,", "d: {status: deprecated, replaced_by: e, source: none,", "catalog.invalid"), ("d: {source: s,", "d: {replaced_by: e, source: s,", "catalog.invalid"),
        ("type: float64}", "type: float65}", "catalog.invalid"),
    ],
)
def test_rules(old, new, code):
    assert old in BASE
    assert code in codes(BASE.replace(old, new, 1))


def test_joined_columns_have_one_type():
    assert "catalog.relationship.join_type_mismatch" in codes(BASE + "relationships:\n  r: {source: s, target: u, type: one_to_many, source_column: id, target_column: id}\n")
    loads(BASE + "relationships:\n  r: {source: s, target: u, type: one_to_many, source_column: id, target_column: n}\n")


def test_fact_reaches_its_sources_without_expansion():
    fact = BASE.replace("  t: {source: s", "  x: {source: s, data_type: double, expression: s.f * u.n}\n  t: {source: s")
    good = fact + "relationships:\n  r: {source: s, target: u, type: many_to_one, source_column: id, target_column: n}\n"
    loads(good)
    assert codes(good.replace("many_to_one", "one_to_many")) == {"catalog.invalid"}


def test_issues_are_sorted_and_all_reported():
    with pytest.raises(CatalogError) as error:
        loads(BASE.replace("column: t", "column: none").replace("aggregation: sum", "aggregation: median"))
    paths = [i.path for i in error.value.issues]
    assert paths == sorted(paths) == ["dimensions.d", "measures.m"]


def test_schema_ref_stays_in_the_folder(tmp_path):
    (tmp_path / "inside").mkdir()
    (tmp_path / "out.yaml").write_text("fields: [{name: id, type: int64, nullable: false}]")
    (tmp_path / "inside" / "in.yaml").write_text("fields: [{name: id, type: int64, nullable: false}]")
    text = "version: 1\nname: x\ndata_sources:\n  s: {type: parquet, location: x, grain: [id], schema_ref: REF}\n"
    (tmp_path / "inside" / "good.yaml").write_text(text.replace("REF", "in.yaml"))
    (tmp_path / "inside" / "bad.yaml").write_text(text.replace("REF", "../out.yaml"))
    assert load(tmp_path / "inside" / "good.yaml").data_sources["s"].grain == ("id",)
    with pytest.raises(CatalogError):
        load(tmp_path / "inside" / "bad.yaml")
