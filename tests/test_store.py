import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import standins
from lodestrata.sources import pages
from lodestrata.sources.store import CatalogStore, Conflict


def _text(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)))).collect())


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_store_gives_back_what_was_put_in(spark, tiny, tmp_path):
    products = standins.products(spark, tiny)
    store = CatalogStore(spark, str(tmp_path / "shop"), buckets=8)
    assert store.read().count() == 0 and store.versions() == []
    assert store.upsert(products) == 1
    assert _text(store.read()) == _text(products)
    found = store.lookup("p77")
    assert [r.name for r in found.collect()] == [r.name for r in products.filter("id = 'p77'").collect()]
    assert store.lookup("nothing").count() == 0
    plan = _plan(found)
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_updates_touch_their_buckets_only(spark, tiny, tmp_path):
    products = standins.products(spark, tiny)
    store = CatalogStore(spark, str(tmp_path / "shop"), buckets=8)
    store.upsert(products)
    before = store._manifest()
    changed = products.filter("id in ('p5', 'p6')").withColumn("name", F.concat("name", F.lit(" II")))
    new = products.filter("id = 'p7'").withColumns({"id": F.lit("x1"), "name": F.lit("New")})
    assert store.upsert(changed.unionByName(new).unionByName(new).unionByName(products.filter("id = 'p8'").withColumn("id", F.lit(None).cast("string")))) == 2
    after = store._manifest()
    moved = {b for b in after["held"] if after["held"][b] != before["held"].get(b)}
    assert 1 <= len(moved) <= 3
    want = products.filter("id not in ('p5', 'p6')").unionByName(changed).unionByName(new)
    assert _text(store.read()) == _text(want) and _text(store.read(1)) == _text(products)
    assert store.remove(spark.createDataFrame([("x1",), ("p5",), ("none",)], "id string")) == 3
    assert _text(store.read()) == _text(want.filter("id not in ('x1', 'p5')"))
    with pytest.raises(ValueError):
        store.read(9)


def test_a_version_is_made_once(spark, tiny, tmp_path):
    products = standins.products(spark, tiny).limit(20)
    one, two = (CatalogStore(spark, str(tmp_path / "shop"), buckets=4) for _ in range(2))
    one.upsert(products)
    stale = two._manifest()
    one.upsert(products.limit(3))
    two._manifest = lambda version=None: stale
    with pytest.raises(Conflict):
        two.upsert(products.limit(5))
    assert one.versions() == [1, 2] and one.read().count() == 20
    folders = lambda: len(list((tmp_path / "shop" / "data").iterdir()))
    assert folders() == 3
    assert one.vacuum(1) == [2] and folders() <= 2 and one.read().count() == 20


def test_emptied_buckets_and_an_emptied_store(spark, tiny, tmp_path):
    products = standins.products(spark, tiny).limit(5)
    store = CatalogStore(spark, str(tmp_path / "shop"), buckets=64)
    store.upsert(products)
    store.remove(products.select("id"))
    assert store.read().count() == 0 and store.lookup("p1").count() == 0
    store.upsert(products)
    assert _text(store.read()) == _text(products)


def test_json_lines_come_back(spark, tiny, tmp_path):
    products = standins.products(spark, tiny)
    pages.write_catalog(products, str(tmp_path / "lines"))
    assert _text(pages.read_catalog(spark, str(tmp_path / "lines"))) == _text(products)
    (tmp_path / "lines" / "more.json").write_text('{"id": "z", "name"\n{"id": "y", "name": "Y"}\n{"name": "no id"}\n')
    assert {r.id for r in pages.read_catalog(spark, str(tmp_path / "lines")).collect()} - {r.id for r in products.collect()} == {"y"}


def test_truth_files(spark, tmp_path):
    (tmp_path / "ace.json").write_text('{"_source_file": "x", "name": "Ace", "price": {"price": 1.5, "currency": "USD"},\n "variants": {"count": 3, "axes": ["Size"]}, "image_urls": ["u"], "_evidence_notes": {"a": "b"}}')
    (tmp_path / "nike.json").write_text('{"name": "Nike", "variants": [{"sku": "s"}]}')
    rows = {r.id: r for r in pages.ground_truth(spark, str(tmp_path)).collect()}
    assert rows["ace"].price.price == 1.5 and rows["ace"].variants.startswith('{"count"')
    assert rows["nike"].variants.startswith("[") and "_source_file" not in rows["ace"].asDict()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "expected.json").write_text('{"a": ["A > B", "A"],\n "b": []}')
    assert {r.id: r.accepted for r in pages.expected_categories(spark, str(tmp_path / "x" / "expected.json")).collect()} == {"a": ["A > B", "A"], "b": []}
