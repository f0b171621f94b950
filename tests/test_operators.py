"""Worked examples, edge cases and properties of the product-evidence operators."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import html, jsontree, text, urls
from lodestrata.operators import catalog, distill, draft, evaluate, media, taxonomy, variants, vectors
from lodestrata.sources import pages
from lodestrata.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


# --- text and urls ---------------------------------------------------------------------------------


def test_identity_tokens_and_overlap(spark):
    tokens = text.identity_tokens(lit("DEWALT 20V Drill Kit"), lit("Compact cordless drill for men"), lit(None).cast("string"))
    assert set(value(spark, tokens)) == {"20v", "compact", "cordless", "dewalt", "drill", "kit"}
    ident = F.array(lit("drill"), lit("kit"))
    names = ("drill bits and more tools", "steel tape measure", "", None, "drill hole saw")  # one of five words is too few, one of three isn't
    assert [value(spark, text.matches_identity(lit(n).cast("string"), ident)) for n in names] == [False, False, True, True, True]
    assert value(spark, text.matches_identity(lit("tape"), F.array().cast("array<string>")))


def test_keys(spark):
    assert value(spark, text.key_norm(lit("consentPolicy-x"))) == "consent_policy_x"
    assert [value(spark, text.is_noise_key(lit(k))) for k in ("consentPolicy", "mainNav", "navigate", "cookies", "price")] == [True, True, False, True, False]


def test_density_and_score(spark):
    assert round(value(spark, text.keyword_density(lit("product price sku image"))), 2) == round(4 / __import__("math").log(33), 2) == 1.14
    assert value(spark, text.commerce_score(F.array().cast("array<string>"))) == 0.0


@pytest.mark.parametrize("number", [0.0, 5.0, 129.0, 129.5, 0.5, 1234.0, 1234.56, 1234.999, 123456.0, 1234567.0, 0.00001234, 297120.5, 297121.5, 0.0009765625, 1234565.0, 1234575.0, 999999.5, 12345.25, 12345.75, 1e15, 123456789012.0, 13405.65, 99999.95, 99999.85, 1234.565, 1234.575, 0.1234565, 0.00012345])
def test_price_forms(spark, number):
    assert value(spark, text.general_format(lit(number))) == f"{number:g}"
    assert f"{number:.2f}" in value(spark, text.price_forms(lit(number)))
    assert {f"{number:,.2f}", f"{number:,.2f}"[:-3]} <= set(value(spark, text.price_forms(lit(number), True))) or number < 1000


def test_fit_and_lines(spark):
    assert value(spark, text.fit(lit("abcd"), 4)) == "abcd" and value(spark, text.fit(lit("abcde"), 4)) == "abcd\n…[truncated]"
    assert value(spark, text.dedupe_lines(lit(" a\na \n\n a\nb\na"))) == "a\nb\na"
    texts = F.array(lit("x" * 50), lit("y" * 80), lit("z"))
    assert value(spark, distill.waterfall(texts, 100, 20)) == "x" * 50 + "\n" + "y" * 50 + "\n…[truncated]"
    assert value(spark, distill.waterfall(F.array(lit("a"), lit(None).cast("string"), lit("b")), 100, 20)) == "a"


def test_asset_key(spark):
    same = ["https://a.com/img/front_400x.jpg?w=3", "//b.org/img/front_1200x800.jpg#z", "https://a.com/img/Large/front_20x.jpg"]
    assert len({value(spark, urls.asset_key(lit(u))) for u in same}) == 1
    assert value(spark, urls.asset_key(lit("https://x.com/p/media_2351fcf55647dca9d1976174ed6b735689038d06.jpg"))) == "p/media-jpg"
    assert value(spark, urls.asset_key(lit("http://host"))) == "http://host"
    assert value(spark, urls.asset_key(lit("https://c.com/c_fit,w=9/q:1/shoe/side.png"))) == "shoe/side-png"


def test_srcset_and_kinds(spark):
    got = value(spark, urls.srcset(lit("a.jpg 640w, , b.jpg 2x,c.jpg")))
    assert [(r.url, r.width) for r in got] == [("a.jpg", 640), ("b.jpg", None), ("c.jpg", None)]
    assert [value(spark, urls.media_kind(lit(u))) for u in ("x.mp4?a", "x.JPG", "/is/image/y", "x.pdf")] == ["video", "image", "image", None]
    assert value(spark, urls.sized_twin(lit("http://a/b.png?w=3"))) == "http://a/b.png" and value(spark, urls.sized_twin(lit("http://a/b?w=3"))) is None


# --- pages and trees -------------------------------------------------------------------------------

PAGE = """<html><head><title> Drill </title><link rel="canonical" href=" https://s.com/d "><meta property="OG:Title" content=" First "><meta property="og:title" content="Second"><meta name="viewport" content="x">
<script type="application/ld+json"><![CDATA[{"@graph":[{"@type":"Product","name":"Drill","image":["https://s.com/img/a.jpg","//s.com/img/b.jpg?w=100"],"offers":[{"price":"12.50","priceCurrency":"USD"}]}]}]]></script>
<script type="application/ld+json">{broken</script></head>
<body><nav>Menu</nav><div role="banner">Top</div><h1>Big <b>Drill</b></h1><p>One<p>One<p>Two<img src="/rel.jpg" alt="Front"><img src="https://s.com/img/a.jpg" srcset="https://s.com/img/a.jpg 800w">
<img src="https://s.com/1x1.gif"><video src="https://s.com/v.mp4"></video><footer>Legal</footer></body></html>"""


def test_evidence(spark):
    harvested = distill.harvest(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), "page_id", "html")
    e = harvested.first().evidence
    assert (e["title"], e["canonical_url"], e["h1"]) == ("Drill", "https://s.com/d", "Big Drill")
    assert e["meta"] == {"og:title": "First"} and len(e["json_ld"]) == 1
    assert e["visible_text"] == "Drill\nBig\nDrill\nOne\nTwo\n[Front]"
    seen = distill.sightings(harvested).orderBy("seq").collect()
    assert [(m["url"], m["origin"], m["width"]) for m in seen] == [
        ("https://s.com/img/a.jpg", "dom", 800), ("https://s.com/v.mp4", "dom", None), ("https://s.com/img/b.jpg?w=100", "json_ld", None), ("https://s.com/img/b.jpg", "json_ld", None),
    ]
    assert seen[0]["path_hint"] == ".@graph.image"


def test_nodes_are_intervals(spark):
    page = "<div><p>a<p>b <b>c</b></div><ul><li>x<li>y</ul><br/>z<svg/></i>"
    nodes = html.parse(page)
    assert [n["pos"] for n in nodes] == list(range(len(nodes)))
    inside = lambda n: "".join(m["text"] or "" for m in nodes[n["pos"] : n["last"] + 1])
    assert [(n["tag"], inside(n)) for n in nodes if n["tag"]] == [("div", "ab c"), ("p", "a"), ("p", "b c"), ("b", "c"), ("ul", "xy"), ("li", "x"), ("li", "y"), ("br", ""), ("svg", "")]
    some = html.parse(page, frozenset({"b", "ul"}))
    assert [(n["pos"], n["last"], n["tag"], n["text"]) for n in some] == [(0, 1, "b", None), (1, 1, None, "c"), (2, 6, "ul", None), (3, 4, "li", None), (4, 4, None, "x"), (5, 6, "li", None), (6, 6, None, "y")]


def test_visible_text_and_labels(spark):
    pages = {
        "<nav>n<aside>a</aside>m</nav>one<div role=navigation>r<p>s</div>two<footer>f": "one\ntwo",
        '<a title="More info" aria-label="More info">go<img alt="The view"></a>end<i title="ab">x</i>': "go\n[The view]\n[More info]\nend\nx",
        '<p aria-label="one two" alt="three">a\x85b</p><script>var x</script>': "a\nb\n[one two | three]",
        "<header><nav>x</nav></header><p>a</p><p>a</p>  <p>\u00a0a </p>b\nb": "a\nb",
        "": "",
    }
    df = spark.createDataFrame([(k, v) for k, v in pages.items()], "html string, want string").select("want", html.page_nodes(F.col("html")).alias("n"))
    for want, got in df.select("want", html.visible_text(F.col("n"))).collect():
        assert got == want


def test_script_channels(spark):
    big = lambda **x: json.dumps(x | {"filler": "x" * 600})
    page = f"""<script>short {{"price":1}}</script><script id=state>window.a = {big(price=1, other=2)};</script><script type="application/JSON">{big(sku=1, price=2)}</script>
    <script>{"product price sku variant " * 20}</script><script>{"nothing of note " * 30}</script><script>var e = "price product sku"; x = {big(nope=1)}; {"price " * 99}</script>"""
    e = distill.harvest(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html").first().evidence
    assert [(b.source, round(b.score, 3), json.loads(b.data)["price"]) for b in e.json_blobs] == [("application/json", 1.155, 2), ("state", 0.577, 1)]
    assert [t.text[:7] for t in e.script_texts] == ["var e =", "product"] and e.script_texts[0].score > e.script_texts[1].score


def test_media_of_all_channels(spark):
    page = """<meta property="og:image" content="//h.com/hero.jpg"><meta name="og:video" content="https://h.com/v.mp4"><meta name="twitter:image" content="https://h.com/a.jpg">
    <img src="https://h.com/a.jpg?w=10" data-src=" //h.com/b.png " data-srcset="https://h.com/a.jpg 99999999999w, https://h.com/c.jpg 300w, https://h.com/a.jpg?w=10 80w">
    <source type="video/mp4" src="https://h.com/w.mp4?w=1" srcset="https://h.com/d.jpg 2x"><source srcset="https://h.com/e.webp 5w">
    <link rel="x preload" as="image" href="https://h.com/f.jpg?q=7"><link rel="preload" as="script" href="https://h.com/no.jpg"><video src="https://h.com/x.webm"></video>
    <img src="/rel.jpg"><img src="https://h.com/pixel.gif"><img src="https://h.com/i.svg"><img src="https://h.com/track/z.jpg">
    <script type="application/ld+json">{"image": "https://h.com/a.jpg", "product": {"image": ["https://h.com/a.jpg", "https://h.com/g.jpg"], "images": "https://h.com/a.jpg"}}</script>"""
    found = distill.sightings(distill.harvest(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html")).orderBy("seq").collect()
    h = "https://h.com/"
    assert [(r.url, r.kind, r.origin, r.width, r.path_hint) for r in found] == [
        (h + "a.jpg?w=10", "image", "dom", 80, ""), (h + "a.jpg", "image", "dom", None, ".image .product.image .product.images"), (h + "b.png", "image", "dom", None, ""), (h + "c.jpg", "image", "dom", 300, ""),
        (h + "w.mp4?w=1", "video", "dom", None, ""), (h + "d.jpg", "video", "dom", None, ""), (h + "e.webp", "image", "dom", 5, ""), (h + "f.jpg?q=7", "image", "dom", None, ""), (h + "f.jpg", "image", "dom", None, ""),
        (h + "x.webm", "video", "dom", None, ""), (h + "hero.jpg", "image", "meta", None, ""), (h + "v.mp4", "video", "meta", None, ""), (h + "g.jpg", "image", "json_ld", None, ".product.image"),
    ]


def test_hints_that_stand_in_others(spark):
    rows = [(1, i, "u", "image", "dom", w, h) for i, (w, h) in enumerate([(None, ".product.image"), (0, ".image"), (5, ".image.x"), (3, None), (None, ".product")])] + [(1, 9, "v", "image", "dom", 0, "")]
    got = media.merged_sightings(spark.createDataFrame(rows, "page int, seq int, url string, kind string, origin string, width int, path_hint string")).orderBy("seq").collect()
    assert [(r.path_hint, r.width) for r in got] == [(".product.image .image.x", 5), ("", 0)]


def test_evidence_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a<b>b</p>c</b></i>"), (4, "plain & text"), (5, "<!-- x --><script>var a = {")], "page_id long, html string")
    rows = {r.id: r.evidence for r in distill.harvest(df, "page_id", "html").collect()}
    assert len(rows) == 5 and rows[1].title is None and rows[3].visible_text == "a\nb\nc" and rows[4].visible_text == "plain & text"
    assert distill.distill(distill.harvest(df, "page_id", "html")).count() == 5


def test_script_objects():
    big = {"product": {"price": 1, "description": "x" * 600}}
    assert jsontree.script_objects(json.dumps(big)) == [big]
    assert jsontree.script_objects(f"var a = {json.dumps(big)}; b = {{\"small\": 1}};") == [big]
    assert jsontree.script_objects("x = JSON.parse(" + json.dumps(json.dumps(big)) + ")") == [big]
    assert jsontree.script_objects("JSON.parse('{\"a\":1}')") == []


def test_prune_and_tabulate():
    before = {"consentPolicy": {"enabled": True}, "description": "", "relatedProducts": [{"name": "Tape", "images": [{}], "ids": [1]}], "stock": 0, "available": False, "x": {"y": None}}
    assert jsontree.prune(before) == {"relatedProducts": [{"name": "Tape", "ids": [1]}], "stock": 0, "available": False}
    assert jsontree.prune("https://s.com/" + "a" * 60 + "/tail.jpg?x") == ".../tail.jpg" and jsontree.prune("z" * 90 + "=>") == "[code]"
    rows = [{"a": i, "b": [1, 2]} for i in range(6)]
    assert jsontree.tabulate(rows)["_rows"][0] == [0, "1|2"] and jsontree.tabulate(rows[:5]) == rows[:5]
    assert jsontree.tabulate([{"a": {"b": {"c": 1}}}] * 6) == [{"a": {"b": {"c": 1}}}] * 6


def test_media_groups(spark):
    rows = [(1, i, f"https://s.com/{n}", "image", o, None, h) for i, (n, o, h) in enumerate([("front.jpg?w=320", "dom", "selected"), ("front.jpg", "blob", "selected"), ("side.jpg", "blob", "selected"), ("back.jpg", "blob", "selected"), ("tape.jpg", "blob", "related")])]
    df = spark.createDataFrame(rows, "page int, seq int, url string, kind string, origin string, width int, path_hint string")
    assert media.per_page(media.ranked(df)).first().images == ["https://s.com/front.jpg", "https://s.com/side.jpg", "https://s.com/back.jpg"]
    many = spark.createDataFrame([(1, i, f"https://s.com/n{i}.jpg", "image", "dom", None, "") for i in range(60)], df.schema)
    assert media.ranked(many).count() == 40 and media.ranked(many, images=400).count() == 60


def test_variants_last_of_a_key_counts(spark):
    truth = '[{"selections":[{"name":"Size","value":"M"}],"sku":null,"price":5.0,"available":true,"image_urls":[]},{"selections":[{"name":"Size","value":"XL"}],"sku":null,"price":5.0,"available":true,"image_urls":[]}]'
    own = lambda size, price: F.struct(F.array(F.struct(lit("SIZE").alias("name"), lit(size).alias("value"))).alias("selections"), lit("s").alias("sku"), lit(price).alias("price"), lit(True).alias("available"), F.array(lit("u")).alias("image_urls"))
    assert value(spark, evaluate.variant_score(lit(truth), F.array(own("m", 5.0), own("m", 9.0)))) == 0.56
    assert value(spark, evaluate.variant_score(lit(truth), F.array(own("m", 9.0), own("m", 5.0)))) == 0.62
    assert value(spark, evaluate.variant_score(lit("[]"), F.array().cast(f"array<{schemas.VARIANT}>"))) == 1.0


def test_batch_keeps_dead_letters(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<title>Bare</title>")], "page_id long, html string")
    contexts = distill.distill(distill.harvest(df, "page_id", "html"))
    paths = taxonomy.prepared(spark.createDataFrame([("Tools > Drill",)], "path string"))
    made, dead = draft.extract_batch(contexts, paths)
    assert [r.id for r in made.collect()] == [1] and [(r.id, r.error) for r in dead.collect()] == [(2, "no category matches")]
    assert {r.ok: (r.n, r.first_id) for r in draft.tally(made, dead).collect()} == {True: (1, 1), False: (1, 2)}


# --- drafts, search, catalog -----------------------------------------------------------------------


def test_drafts(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<title>Bare</title>")], "page_id long, html string")
    contexts = distill.distill(distill.harvest(df, "page_id", "html"))
    good, dead = draft.drafted(contexts, [draft.RuleDrafter()])
    rows = {r.id: r.draft for r in good.collect()}
    assert rows[1].name == "Drill" and rows[1].price == 12.5 and rows[1].image_ids == [0, 1] and rows[2].name == "Bare" and dead.count() == 0
    assert {r.ok: r.n for r in draft.tally(good, dead).collect()} == {True: 2}
    d = F.struct(lit(7.0).alias("price"), lit(None).cast("double").alias("compare_at_price"), F.array(lit(2), lit(-1)).alias("image_ids"))
    free = F.struct(lit(0.0).alias("price"), lit(None).cast("double").alias("compare_at_price"), F.array(lit(0)).alias("image_ids"))
    assert value(spark, draft.problems(free, lit("costs 8"), lit(2))) == ["price 0 is not on the page"] and value(spark, draft.problems(free, lit("0 now"), lit(2))) == []
    assert value(spark, draft.problems(d, lit("costs 8"), lit(2))) == ["price 7 is not on the page", "image ids must be 0 to 1"]
    base = draft.baseline(distill.harvest(df, "page_id", "html"), taxonomy.prepared(spark.createDataFrame([("Tools > Drills",)], "path string")))
    got = {r.id: r for r in base.collect()}
    assert got[1].category.name == "Tools > Drills" and got[2].price.price == 0.0 and got[1].name == "Drill"


def test_retrieval(spark):
    paths = taxonomy.prepared(spark.createDataFrame([(p,) for p in ("Tools", "Tools > Drills", "Toys > Drill Sets", "Food")], "path string"))
    asked = spark.createDataFrame([("a", "cordless drills"), ("b", "zzz")], "q string, text string")
    found = taxonomy.lexical_topk(asked, paths, 5)
    assert [(r.q, r.path) for r in found.orderBy("rank").collect()] == [("a", "Toys > Drill Sets"), ("a", "Tools > Drills")]
    more = taxonomy.with_top_levels(found, asked, paths)
    assert [r.path for r in more.filter("q = 'a'").orderBy("rank").collect()] == ["Toys > Drill Sets", "Tools > Drills", "Food", "Tools"]
    assert [r.q for r in taxonomy.resolved(asked, paths).collect()] == ["a"]
    food = lambda rest, k: rest.select("q", F.lit("Food").alias("path"), F.lit(1).alias("rank"))
    assert {r.q: r.category for r in taxonomy.resolved(asked, paths, vector=food).collect()} == {"a": "Toys > Drill Sets", "b": "Food"}
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "path int, embedding array<float>")
    near = vectors.vector_topk(rows.withColumnRenamed("path", "q"), rows, 2)
    assert [r.path for r in near.filter("q = 1").orderBy("rank").collect()] == [1, 3]
    assert vectors.vector_topk(rows.withColumnRenamed("path", "q"), rows.limit(0), 2).count() == 0
    assert abs(value(spark, vectors.cosine(F.array(lit(1.0), lit(2.0)), F.array(lit(2.0), lit(4.0)))) - 1) < 1e-6


def variant(color=None, size=None, sku=None, price=None, stock=None, images=()):
    chosen = [{"name": n, "value": v} for n, v in (("Color", color), ("Size", size)) if v]
    return {"selections": chosen, "sku": sku, "price": price, "available": stock, "image_urls": list(images)}


ROWS = [variant("Navy", "M", "N-M", None, True, ["navy-1", "{tpl}"]), variant("Navy", "L", "N-L", None, False, ["navy-1", "navy-2"]), variant("Lake", "M", "L-M", 24.99, True)]


def chosen(**axes):
    return F.create_map(*(lit(x) for kv in axes.items() for x in kv)) if axes else F.create_map().cast("map<string,string>")


def of(spark, rows, column):
    df = spark.createDataFrame([(rows, [{"name": "Color", "values": ["Navy", "Lake"]}, {"name": "Size", "values": ["M", "L"]}])], f"v array<{schemas.VARIANT}>, o array<{schemas.OPTION}>")
    return df.select(column.alias("x")).first().x


def test_variants(spark):
    v, o = F.col("v"), F.col("o")
    match = lambda rows, **axes: of(spark, rows, variants.matches(F.get(v, lit(0)), chosen(**axes)))
    assert match(ROWS, Color="Navy", Size="M") and match([variant("Navy")], Color="Navy", Size="M") and not match(ROWS, Color="Lake")
    resolve = lambda rows, **axes: getattr(of(spark, rows, variants.resolve(v, chosen(**axes))), "sku", None)
    assert resolve(ROWS, Color="Lake", Size="M") == "L-M" and resolve(ROWS, Color="Navy") is None
    assert resolve([variant(None, "M", "S-M"), *ROWS], Color="Navy", Size="M") == "N-M"
    images = lambda rows, **axes: of(spark, rows, variants.images(v, chosen(**axes)))
    assert images(ROWS, Color="Navy") == ["navy-1", "navy-2"] and images(ROWS) == [] and images(ROWS, Color="Lake") == []
    off = lambda rows, axis, choice, **axes: of(spark, rows, variants.disabled(v, o, chosen(**axes), lit(axis), lit(choice)))
    assert off(ROWS, "Size", "L", Color="Lake") and not off(ROWS, "Size", "L", Color="Navy") and not off(ROWS, "Color", "Navy", Color="Lake", Size="M")
    assert not off([], "Size", "L", Color="Lake") and not of(spark, ROWS[:2], variants.dense(v, o))
    assert of(spark, ROWS, variants.toggled(chosen(Color="Navy"), lit("Color"), lit("Navy"))) == {}
    assert of(spark, ROWS, variants.jump_to(v, chosen(Color="Navy"), F.array(lit("x"), lit("navy-2")))) == "navy-2"


def test_catalog(spark, tmp_path):
    products = spark.createDataFrame([("a", "Drill", "DeWalt", (10.0, "USD", 12.0), ["u", "v"], ("T",)), ("b", "Tape", "Ring", (5.0, "JPY", None), [], ("T > X",))],
                                     "id string, name string, brand string, price struct<price:double,currency:string,compare_at_price:double>, image_urls array<string>, category struct<name:string>")
    rows = catalog.summaries(products, products.filter("id = 'a'"))
    assert [(r.id, r.hover_image_url, r.source) for r in rows.orderBy("id").collect()] == [("a", "v", "assignment"), ("b", None, "unseen")]
    assert catalog.search(rows, "dewalt").count() == 1 and catalog.search(rows, " ").count() == 2 and catalog.search(rows, "", "unseen").count() == 1
    assert catalog.detail(products, "a")["name"] == "Drill"
    with pytest.raises(catalog.NotFound):
        catalog.detail(products, "zz")
    assert value(spark, catalog.percent_off(lit(10.0), lit(12.0))) == 17 and value(spark, catalog.percent_off(lit(10.0), lit(9.0))) is None
    labels = spark.createDataFrame([(1234.5, "jpy"), (1234.5, " usd"), (0.005, "EUR"), (-7.0, "GBP"), (1.0, "kwd"), (2.0, "ABC"), (3.0, None), (None, "USD")], "amount double, code string")
    shown = {(r.amount, r.code): r.price_label for r in catalog.with_price_label(labels, catalog.currencies(spark), F.col("amount"), F.col("code")).collect()}
    assert [shown[r.amount, r.code] for r in labels.collect()] == ["¥1,235", "$1,234.50", "€0.01", "-£7.00", "KWD 1.000", "2.00 ABC", "3.00", None]
    slides, dead = F.array(lit("a"), lit("b"), lit("c")), F.array(lit(0))
    assert [value(spark, catalog.current_slide(slides, dead, lit(i))) for i in (0, 1, 2, 9, -1)] == ["b", "b", "c", "b", "b"]
    (tmp_path / "good.json").write_text('{"name": "N", "image_urls": [],\n "price": {"price": 1}}')
    (tmp_path / "bad.json").write_text('{"name": ')
    assert [r.id for r in pages.catalog(spark, str(tmp_path)).collect()] == ["good"] and [r.id for r in pages.damaged(spark, str(tmp_path)).collect()] == ["bad"]
    (tmp_path / "t.txt").write_text("# c\nA > B\n\nA > B \n")
    assert [r.path for r in pages.taxonomy_file(spark, str(tmp_path / "t.txt")).collect()] == ["A > B"]
    (tmp_path / "p.html").write_bytes(b"<p>a\xffb</p>")
    assert pages.page_files(spark, str(tmp_path / "*.html")).first().html == "<p>ab</p>"


# --- scores ----------------------------------------------------------------------------------------


def test_scores(spark):
    assert [value(spark, evaluate.name_score(lit(a), lit(b))) for a, b in (("Big Drill!", "big drill kit"), ("A", "b"), ("A", ""))] == [1.0, 0.0, 1.0]
    assert value(spark, evaluate.text_score(lit("a b c d"), lit("a b x"))) == 0.67 and value(spark, evaluate.text_score(lit(""), lit("x"))) == 0.0
    urls_of = lambda *x: F.array(*map(lit, x)) if x else F.array().cast("array<string>")
    assert value(spark, evaluate.image_score(urls_of("https://a/b/x.jpg", "https://a/b/y.jpg"), urls_of("https://c/b/x.jpg?w=1"))) == 0.67
    assert value(spark, evaluate.color_score(urls_of(), urls_of("red"))) == 0.5 and value(spark, evaluate.color_score(urls_of("Red"), urls_of(" red!"))) == 1.0
    assert value(spark, evaluate.category_score(lit("A > B"), lit("A"))) == 0.5 and value(spark, evaluate.video_score(lit(None).cast("string"), lit(""))) == 1.0
    score = lambda truth, rows: of(spark, rows, evaluate.variant_score(lit(json.dumps(truth)), F.col("v")))
    assert score(ROWS, ROWS) == 1.0 and score([], []) == 1.0 and score([], ROWS) == 0.0
    assert score({"count": 6, "axes": ["Color", "Fit"]}, ROWS) == 0.5
    assert score(ROWS, [*ROWS[:2], variant("Lake", "M", "x", 1.0, False), ROWS[0]]) == round(0.5 + 0.75 * 0.25 + (1 + 1 + 0.5) / 3 * 0.25, 2)


def test_missing_products_score_nothing(spark):
    truth = spark.createDataFrame([], f"id string, {schemas.TRUTH}").union(spark.createDataFrame([("a", "N", (1.0, "USD", None), "d", [], [], None, ("C",), "b", [], [], "[]")], f"id string, {schemas.TRUTH}"))
    out = spark.createDataFrame([], f"id string, {schemas.PRODUCT}")
    row = evaluate.page_means(evaluate.field_scores(truth, out)).first()
    assert row["mean"] == 0.0 and len(row.misses) == 9 and not evaluate.scoreboard(evaluate.field_scores(truth, out)).first().passes


# --- streams ---------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows = [(1, "u", "<p>x</p>", "2024-01-01 00:00:00"), (2, "u", "<p>y</p>", "2024-01-01 00:01:00"), (3, "w", None, "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.first_seen(ingest.page_stream(spark, str(tmp_path / "in")))
    work = lambda batch: (batch.filter("html is not null"), batch.filter("html is null"))
    ingest.split_sink(stream, work, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).select("url").collect()[0].url == "u" and spark.read.parquet(str(tmp_path / "dead")).count() == 1
    prices = spark.createDataFrame([("u", "2024-01-01", 1.0), ("u", "2024-01-02", 1.0), ("u", "2024-01-03", 2.0)], "url string, ts string, price double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.before, r.price) for r in ingest.price_changes(prices).collect()] == [(1.0, 2.0)]
    prices.coalesce(1).write.parquet(str(tmp_path / "prices"))
    seen = spark.readStream.schema(prices.schema).parquet(str(tmp_path / "prices"))
    q = ingest.price_change_stream(seen).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert [(r.before, r.price) for r in spark.sql("select * from changes").collect()] == [(1.0, 2.0)]
