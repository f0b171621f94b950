import contextlib
import io

from pyspark.sql import functions as F

from lodestrata.operators import catalog, evaluate, search


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    rows = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate([("Ring light", "Brand#1"), ("String", None), ("DRILL", "Éclair"), ("", ""), (None, None), ("ri", "ng"), ("a.b*c", "İx"), ("ring ring", "ring")])], "id long, name string, brand string")
    value = F.concat_ws(" ", "name", "brand")
    index = search.write_index(rows, value, str(tmp_path / "index"))
    again = search.read_index(spark, str(tmp_path / "index"))
    for query in ("ring", " RING ", "ri", "", "  ", "brand#1", "ring b", "xyz", "éclair", "b*c", "ring ring ring", "ring light brand#1", "l é"):
        want = sorted(r.id for r in catalog.search(rows, query).collect())
        assert sorted(r.id for r in search.substring_search(rows, value, index, query).collect()) == want, query
        assert sorted(r.id for r in search.substring_search(rows, value, again, query).collect()) == want, query


def test_a_search_reads_the_postings_of_rare_grams(spark, tmp_path):
    rows = spark.range(3000).select("id", F.concat(F.lit("common part "), F.col("id").cast("string")).alias("name"))
    index = search.write_index(rows, F.col("name"), str(tmp_path / "index"))
    assert search.rarest(index, "part 2999")[:2] == ["999", "299"]
    assert search.rarest(index, "zzz") is None
    found = search.substring_search(rows, F.col("name"), index, "part 2999")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain("formatted")
    assert "PushedFilters: [In(gram" in out.getvalue() and [r.id for r in found.collect()] == [2999]


def test_least_budgets(spark):
    facts = spark.createDataFrame([(1, "Blue"), (1, "tail"), (1, "none"), (1, "edge"), (2, "x")], "id long, fact string")
    channels = spark.createDataFrame([(1, "a blue thing" + "." * 84 + "edge" + "." * 100 + "tail", 100), (1, "." * 9 + "tail", 10), (3, "x", 5)], "id long, text string, budget int")
    got = {(r.id, r.fact): r.scale for r in evaluate.least_budgets(facts, channels, (4, 1, 2)).collect()}
    assert got == {(1, "Blue"): 1.0, (1, "edge"): 1.0, (1, "tail"): 2.0, (1, "none"): None, (2, "x"): None}
