"""What a review of round 3 found."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions import html, urls
from lodestrata.operators import media, taxonomy, vectors
from lodestrata.plans import standins


def test_references_need_their_semicolon():
    page = "<title>a &amp; b&amp&copy;&am &ampx; &quot</title><script>if (a&&b) c&amp;d</script><a href='?a=1&copy=2&amp;b'>&#65;"
    texts = [n["text"] for n in html.parse(page) if n["text"]]
    assert texts == ["a & b&amp©&am &ampx; &quot", "if (a&&b) c&amp;d", "A"]
    assert next(n["attrs"] for n in html.parse(page) if n["tag"] == "a") == {"href": "?a=1&copy=2&b"}


def test_equal_word_sets_are_searched_once(spark):
    paths = taxonomy.prepared(spark.createDataFrame([("Toys",), *((f"Toys > {a} > {b}{i}",) for a in ("Blocks", "Cars") for b in ("red ", "blue ") for i in range(7))], "path string"))
    texts = ["red cars", "cars RED", "Car, red!", "blue blocks", "nothing like it", "of", None, "toys"]
    drafts = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts * 3)] + [(None, "red cars")], "q string, text string")
    words = lambda t: {w[:-1] if len(w) > 3 and w[-1] == "s" else w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 2}
    rows, want = [r.path for r in paths.select("path").collect()], {}
    for q, t in drafts.filter("q is not null").collect():
        scored = [(len(words(t) & words(p)) + 1.5 * len(words(t) & words(p) & words(p.split(">")[-1])) + 0.05 * p.count(">"), p) for p in rows if words(t) & words(p)]
        want[q] = [p for _, p in sorted(scored, reverse=True)[:5]]
    got = taxonomy.lexical_topk(drafts.filter("q is not null"), paths, 5).orderBy("q", "rank").collect()
    assert {q: [r.path for r in got if r.q == q] for q in want} == want
    picked = taxonomy.picked(drafts, paths, picker=taxonomy.best_option, sizes=(5,))
    assert {r.q: r.category for r in picked.collect()} == {q: p[0] for q, p in want.items() if p}
    plain = taxonomy.lexical_topk(drafts.filter("q is not null"), paths, 1)
    assert {r.q: r.path for r in plain.collect()} == {q: p[0] for q, p in want.items() if p}


def test_pages_are_made_in_all_tasks(spark, tiny):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (standins.product_pages(spark, tiny), standins.rich_pages(spark, tiny)):
        assert made.rdd.getNumPartitions() == tasks
    noise = [urls.is_noise(F.lit(u)) for u in ("https://a/b.SVG", "https://a/b.svg?x", "https://a/b.svg\n", "https://a/1x1.gif", "https://a/1X1.gif")]
    assert list(spark.range(1).select(*(n.alias(f"n{i}") for i, n in enumerate(noise))).first()) == [True, False, False, True, False]


def test_a_tile_of_products_is_small_and_changes_nothing(monkeypatch):
    draw = np.random.default_rng(1)
    asked, known = draw.standard_normal((20, 8)), draw.standard_normal((300, 8))
    assert 8 * vectors.TILE <= 8 << 20
    whole = vectors._best(asked, known, [f"d{i}" for i in range(300)], 10)
    monkeypatch.setattr(vectors, "TILE", 700)
    assert vectors._best(asked, known, [f"d{i}" for i in range(300)], 10) == whole


def test_sightings_are_dealt_once(spark, tiny):
    plan = media.ranked(standins.media_rows(spark, tiny))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
