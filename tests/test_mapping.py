import pytest
from pyspark.sql import Row

from kindred.operators import mapping as m
from kindred.sources.readers import catalog


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        Row(**{" Name ": "Acme", "City.Zip": "Rome, , 00100 ,  IT", "tags": ["a", "it's"], "year": 2015.0, "web": None}),
        Row(**{" Name ": None, "City.Zip": " ", "tags": [], "year": None, "web": "w"}),
    ]
    schema = "` Name ` string, `City.Zip` string, tags array<string>, year double, web string"
    return spark.createDataFrame(rows, schema)


def column(df, table, entry, as_list=False):
    spec = m.parse_spec({"x": entry})
    return [r[0] for r in df.select(m.attribute_column(df, table, spec["x"], as_list)).collect()]


def test_one_to_one(shop):
    assert column(shop, "shop", ["shop.Name", "other.Name", "nodot"]) == ["Acme", None]
    assert column(shop, "shop", {"sources": ["shop.Name", "shop.year"], "merge_delimiter": "/"}) == ["Acme/2015.0", None]
    assert column(shop, "shop", ["shop.tags"]) == ["['a', \"it's\"]", None]
    assert column(shop, "shop", ["shop.missing"]) == [None, None]
    assert column(shop, "shop", 12) == [None, None]


def test_many_to_one_keeps_null(shop):
    entry = {"sources": ["shop.Name", "shop.web"], "relation": "many-to-one", "merge_delimiter": ";"}
    assert column(shop, "shop", entry) == ["Acme", "w"]


def test_one_to_many(shop):
    base = {"sources": ["shop.City.Zip"], "relation": "one-to-many", "split_delimiter": ","}
    assert column(shop, "shop", base, as_list=True) == [["Rome", "00100", "IT"], []]
    assert column(shop, "shop", base) == ["['Rome', '00100', 'IT']", "[]"]
    assert column(shop, "shop", {**base, "take_index": 2}) == ["IT", None]
    assert column(shop, "shop", {**base, "take_index": 3, "take_first": True}) == [None, None]
    assert column(shop, "shop", {**base, "take_index": -1}) == [None, None]
    assert column(shop, "shop", {**base, "take_first": True}) == ["Rome", None]
    assert column(shop, "shop", {**base, "split_delimiter": "."}, as_list=True) == [["Rome, , 00100 , IT"], []]
    assert column(shop, "shop", {"sources": ["shop.Name"], "relation": "one-to-many"}) == ["Acme", None]


def test_unknown_relation(shop):
    assert column(shop, "shop", {"sources": ["shop.Name", "shop.web"], "relation": "?"}) == ["Acme", "w"]


def test_table_rules_override_only_their_table(shop):
    entry = {
        "sources": ["shop.City.Zip", "other.City.Zip"],
        "split_delimiter": ",",
        "table_rules": {"shop": {"relation": "one-to-many", "take_index": 0}},
    }
    assert column(shop, "shop", entry) == ["Rome", None]
    assert column(shop, "other", entry) == ["Rome, , 00100 ,  IT", " "]


def test_populate(spark, shop):
    spec = m.parse_spec({"name": ["shop.Name", "b.n"], "tokens": {
        "sources": ["shop.City.Zip", "b.n"], "relation": "one-to-one",
        "table_rules": {"shop": {"relation": "one-to-many", "split_delimiter": ","}}}})
    other = spark.createDataFrame([("Zed",)], "n string")
    out = m.populate(spark, {"shop": shop, "b": other}, spec)
    assert out.columns == ["name", "tokens", "_source_table"]
    assert [tuple(r) for r in out.collect()] == [
        ("Zed", ["Zed"], "b"), ("Acme", ["Rome", "00100", "IT"], "shop"), (None, [], "shop")]
    empty = m.populate(spark, {}, spec)
    assert empty.columns == out.columns and empty.count() == 0


def test_one_select_per_source(shop):
    spec = m.parse_spec({"a": ["shop.Name"], "b": {"sources": ["shop.City.Zip"], "relation": "one-to-many", "split_delimiter": ","}})
    plan = m.transform_table(shop, "shop", spec)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_mapping_document_and_coverage(spark, shop):
    doc = '```json\n{"name": ["shop. Name", "bare"], "zip": ["shop.City.Zip", "shop.gone"]}\n```'
    rows = m.mapping_rows(spark.createDataFrame([(doc,), ("not json",)], "document string"))
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("name", "shop", " Name"), ("zip", "shop", "City.Zip"), ("zip", "shop", "gone")]
    covered = m.coverage(catalog({"shop": shop}), rows).collect()
    status = {(r.table, r.column): r.status for r in covered}
    values = {(r.table, r.column): (r.n_values, r.attributes) for r in covered}
    assert values[("shop", "Name")] == (1, "name")
    assert values[("shop", "gone")] == (0, "zip")
    assert status[("shop", "Name")] == "used" and status[("shop", "gone")] == "dangling"
    assert status[("shop", "web")] == "unused"


def test_write_mediated(spark, shop, tmp_path):
    spec = m.parse_spec({"name": ["shop.Name"]})
    m.write_mediated(m.populate(spark, {"shop": shop}, spec), str(tmp_path / "out"))
    assert (tmp_path / "out" / "_source_table=shop").is_dir()
