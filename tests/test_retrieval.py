import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import taxonomy, vectors
from lodestrata.sources.pages import table


def test_vector_search_keeps_ties_and_drops_none(spark, monkeypatch):
    """Many blocks of either side, with ties in all of them."""
    monkeypatch.setattr(vectors, "PATH_BLOCK", 7000)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    n = 200_500
    angle = (F.col("id") % 1000) * 0.003
    paths = spark.range(n).select(F.col("id").alias("path"), F.array(F.cos(angle), F.sin(angle)).alias("embedding")).repartition(5)
    asked = paths.filter("path < 2").withColumnRenamed("path", "q")
    got = {(r.q, r["rank"]): r.path for r in vectors.vector_topk(asked, paths, 210).collect()}
    want = {(q, i + 1): q + 1000 * i for q in (0, 1) for i in range(200)}
    assert {x: got[x] for x in want} == want and len(got) == 420


def _rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "path long, embedding array<double>")


@pytest.mark.parametrize("block", [37, 1 << 15])
def test_exact_and_all_lists_agree_with_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "PATH_BLOCK", block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", max(3, block // 8))
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (600, 6)).astype(float)  # repeated vectors, ties and zeros
    x[:200] = x[0]
    paths = _rows(spark, x).unionByName(spark.createDataFrame([(10_000, None)], "path long, embedding array<double>"))
    asked = paths.filter("path % 40 = 0").withColumnRenamed("path", "q")
    norms = np.sqrt((x**2).sum(axis=1))
    want = []
    for q in range(0, 600, 40):
        score = np.round(np.einsum("d,pd->p", x[q], x) / (norms[q] * norms + 1e-9), 12)
        want += [(q, int(p), r + 1) for r, p in enumerate(np.lexsort((np.arange(600), -score))[:20])]
    exact = vectors.vector_topk(asked.unionByName(asked), paths, 20)
    assert sorted((r.q, r.path, r["rank"]) for r in exact.collect()) == sorted(want)
    lists = vectors.train_lists(paths, 9)
    assert len(lists.centroids) == 9
    listed = vectors.list_topk(asked, vectors.with_lists(paths, lists), lists, 20, probes=9)
    assert sorted((r.q, r.path, r["rank"]) for r in listed.collect()) == sorted(want)


def test_recall_of_a_few_lists(spark, small):
    rows = table(spark, small, "embeddings")
    known, asked = rows.select(F.col("vec_id").alias("path"), "embedding"), rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    lists = vectors.train_lists(known)
    assert 1 < lists.probes < len(lists.centroids) == 22
    exact = {(r.q, r.path) for r in vectors.vector_topk(asked, known, 10).collect()}
    listed = {(r.q, r.path) for r in vectors.list_topk(asked, vectors.with_lists(known, lists), lists, 10).collect()}
    assert len(exact & listed) >= 0.9 * len(exact)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "path string, embedding array<float>")
    some = spark.createDataFrame([("a", [1.0])], "path string, embedding array<float>")
    assert vectors.train_lists(none).centroids.shape == (0, 0)
    for asked, known in ((none, some), (some, none), (none, none)):
        assert vectors.vector_topk(asked.withColumnRenamed("path", "q"), known).count() == 0


def test_the_number_of_queries_makes_no_jobs(spark):
    paths = _rows(spark, np.eye(4))

    def jobs(n):
        spark.sparkContext.setJobGroup(f"g{n}", "")
        asked = spark.range(n).select(F.col("id").alias("q"), F.array(*(F.rand(i) for i in range(4))).alias("embedding"))
        vectors.vector_topk(asked, paths, 2).write.format("noop").mode("overwrite").save()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"g{n}"))

    assert jobs(10) == jobs(9000)


def test_shortlist_has_all_top_levels(spark):
    paths = spark.range(10_050).select(F.format_string("p%06d", "id").alias("path"), F.lit(True).alias("is_top"))
    none = spark.createDataFrame([], "q int, path string, rank int")
    asked = spark.createDataFrame([(1,)], "q int")
    assert taxonomy.union_shortlist(none, none, asked, paths).count() == taxonomy.union_shortlist(none, None, asked, paths).count() == 10_050
    assert taxonomy.with_top_levels(none.selectExpr("*", "0D as score").select("q", "path", "score", "rank"), asked, paths).count() == 10_050


def test_retry_with_a_longer_list_and_range_check(spark):
    """The wanted path is the last but some of the lexical list: 100 options lack it, 300 have it."""
    names = [f"Tools > Drill {i:03d}" for i in range(400)] + ["Tools", "Food"]
    paths = taxonomy.prepared(spark.createDataFrame([(p,) for p in names], "path string"))
    drafts = spark.createDataFrame([("first", "drill"), ("second", "drill"), ("never", "drill"), ("wild", "drill"), ("none", "drill")], "q string, text string")
    want = spark.createDataFrame([("first", "Tools > Drill 350"), ("second", "Tools > Drill 150"), ("never", "Tools > Drill 001")], "q string, want string")
    sizes = []

    def picker(shortlists):
        sizes.append({r.q: r.n for r in shortlists.select("q", F.size("options").alias("n")).collect()})
        wild = F.when(F.col("q") == "wild", 9999).when(F.col("q") != "none", F.array_position("options", F.col("want")) - 1)
        return shortlists.join(want, "q", "left").select("q", wild.alias("idx"))

    got = {r.q: (r.category, r.attempt, r.idx) for r in taxonomy.picked(drafts, paths, None, picker).collect()}
    assert got == {"first": ("Tools > Drill 350", 1, 49), "second": ("Tools > Drill 150", 2, 249)}
    assert sizes == [{q: 102 for q in ("first", "second", "never", "wild", "none")}, {q: 302 for q in ("second", "never", "wild", "none")}]


def test_modes(spark):
    paths = taxonomy.prepared(spark.createDataFrame([(p,) for p in ("Tools", "Tools > Drills", "Garden > Hoses", "Food")], "path string"))
    drafts = spark.createDataFrame([("a", "drills"), ("b", "zzz")], "q string, text string")
    near = lambda rows, k: rows.select("q", F.lit("Garden > Hoses").alias("path"), F.lit(1).alias("rank"))
    of = lambda **x: {r.q: r.category for r in taxonomy.resolved(drafts, paths, near, **x).collect()}
    assert of() == {"a": "Tools > Drills", "b": "Garden > Hoses"} and of(mode="lexical") == {"a": "Tools > Drills"}
    with pytest.raises(ValueError):
        of(mode="other")


def test_embeddings_are_made_once(spark, tmp_path):
    seen = []

    def embed(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return texts.select("text", F.array(F.length("text").cast("double")).alias("embedding"))

    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    at = str(tmp_path / "cache")
    of = lambda model, *t: {r.text: r.embedding for r in vectors.embedded(rows(*t), embed, at, model).collect()}
    assert of("m", "a", "bb", "a", None) == {"a": [1.0], "bb": [2.0]}
    assert of("m", "a", "bb") == {"a": [1.0], "bb": [2.0]}
    assert of("m", "a", "ccc") == {"a": [1.0], "ccc": [3.0]}
    assert of("other", "a") == {"a": [1.0]}
    assert of("m", "bb") == {"bb": [2.0]}
    assert seen == [["a", "bb"], [], ["ccc"], ["a"], []]


def test_ranker_with_a_cache(spark, tmp_path):
    paths = taxonomy.prepared(spark.createDataFrame([("Tools > Drills",), ("Food > Pears",)], "path string"))
    drafts = spark.createDataFrame([(1, "drills and tools"), (2, "pear")], "q long, text string")
    for _ in range(2):
        ranker = taxonomy.embedding_ranker(paths, vectors.hashing_embedder(), str(tmp_path / "paths"), "hashed-32")
        assert {r.q: r.path for r in ranker(drafts, 1).collect()} == {1: "Tools > Drills", 2: "Food > Pears"}
