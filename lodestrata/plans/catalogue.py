"""Queries of the product-evidence operators over the test tables, with their oracles in DuckDB SQL.

Every query reads whole tables. Where the operators work on things that the tables lack (product pages, media, variants), the
inputs are the stand-ins of plans/standins.py, which SQL restates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import html, jsontree, text, urls
from lodestrata.functions.materialize import materialized, shared_folder
from lodestrata.operators import catalog, distill, draft, evaluate, media, search, taxonomy, usage, variants, vectors
from lodestrata.plans import standins
from lodestrata.sources.pages import table
from lodestrata.sources.store import CatalogStore
from lodestrata.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle if SQL has one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# --- pages -----------------------------------------------------------------------------------------

_UNESCAPED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_LINES = "list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_WITHOUT_REPEATS = "array_to_string(list_filter({0}, lambda x, i: i = 1 OR x <> {0}[i - 1]), chr(10))"


@query(f"""SELECT page_id, trim({_UNESCAPED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
    trim({_UNESCAPED.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}) AS h1 FROM pages""")
def page_identity(spark, sf_dir):
    nodes = table(spark, sf_dir, "pages").select("page_id", html.page_nodes(F.col("html"), "title", "h1").alias("nodes"))
    return nodes.select("page_id", html.title(F.col("nodes")).alias("title"), html.heading(F.col("nodes")).alias("h1"))


_CHROME = "|".join(f"<{t}\\b.*?</{t}>" for t in ("script", "style", "noscript", "svg", "iframe", "nav", "header", "footer", "aside"))


@query(f"""WITH t AS (SELECT page_id, {_LINES.format(_UNESCAPED.format(f"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '{_CHROME}', chr(10), 'gis'), '<[^>]*>', chr(10), 'g')"))} AS ls FROM pages)
    SELECT page_id, length({_WITHOUT_REPEATS.format("ls")}) AS n_chars, md5({_WITHOUT_REPEATS.format("ls")}) AS digest FROM t""")
def visible_text(spark, sf_dir):
    nodes = table(spark, sf_dir, "pages").select("page_id", html.page_nodes(F.col("html")).alias("nodes"))
    shown = nodes.select("page_id", html.visible_text(F.col("nodes")).alias("t"))
    return shown.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


_IDENTITY = """list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', {})), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the','and','for','with','men','mens','women','womens','s')))"""


@query(f"""WITH p AS (SELECT page_id, {_UNESCAPED.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, trim({_UNESCAPED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
        regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages),
    t AS (SELECT page_id, {_IDENTITY.format("h1, title")} AS ident, list_distinct(list_filter(regexp_extract_all(lower(host), '[a-z0-9]+'), lambda w: length(w) > 2)) AS own FROM p)
    SELECT page_id, CAST(len(ident) AS BIGINT) AS n_identity, len(own) = 0 OR len(ident) = 0 OR len(list_intersect(own, ident)) / len(own)::DOUBLE >= 0.3 AS matches FROM t""")
def identity_overlap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = distill.harvest(pages, "page_id", "html").select(F.col("id").alias("page_id"), text.identity_tokens(F.col("evidence.h1"), F.col("evidence.title")).alias("ident"))
    host = pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("host"))
    return found.join(host, "page_id").select("page_id", F.size("ident").cast("long").alias("n_identity"), text.matches_identity(F.col("host"), F.col("ident")).alias("matches"))


@query("SELECT page_id, string_split(url, '?')[1] AS plain, regexp_matches(url, '(?i)analytics|beacon|pixel|track|telemetry|metrics|/api/|doubleclick|facebook\\.com/tr|pinterest\\.com/v3|bat\\.bing|noscript=1') OR contains(url, '1x1') OR ends_with(lower(url), '.svg') AS noise FROM pages")
def url_strip(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.without_query(u).alias("plain"), urls.is_noise(u).alias("noise"))


_PART_URL = "'https://cdn.example.com/img/w_' || p_size || ',c_fit/' || replace(p_name, ' ', '-') || '/Large-' || p_partkey || '-0af3b' || (p_partkey % 10) || 'c9/' || p_partkey || '_400x' || (p_size * 10) || '.jpg?w=200#x'"


@query(f"""WITH u AS (SELECT p_partkey, {_PART_URL} AS url FROM part),
    b AS (SELECT p_partkey, regexp_replace(string_split(string_split(url, '?')[1], '#')[1], '/\\d{{2,4}}x\\d{{0,4}}/|_\\d{{2,4}}x\\d{{0,4}}\\.|w_\\d+|h_\\d+', '/.', 'g') AS base FROM u),
    s AS (SELECT p_partkey, list_filter(list_transform(list_filter(string_split(replace(base, '/.', '/'), '/')[4:], lambda x: NOT regexp_matches(x, '[,:=]')),
        lambda x: array_to_string(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ('mini','thumb','thumbnail','standard','full','max','square','small','large','medium','micro','zoom','default','original')
            AND NOT (length(t) >= 6 AND regexp_full_match(t, '[0-9a-f]+') AND regexp_matches(t, '[a-f]')) AND NOT regexp_full_match(t, '\\d{{2,4}}x\\d{{0,4}}')), '-')), lambda x: x <> '') AS segs FROM b)
    SELECT p_partkey, array_to_string(segs, '/') AS asset FROM s""")
def asset_key(spark, sf_dir):
    c = F.concat
    url = c(F.lit("https://cdn.example.com/img/w_"), F.col("p_size").cast("string"), F.lit(",c_fit/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/Large-"), F.col("p_partkey").cast("string"),
            F.lit("-0af3b"), (F.col("p_partkey") % 10).cast("string"), F.lit("c9/"), F.col("p_partkey").cast("string"), F.lit("_400x"), (F.col("p_size") * 10).cast("string"), F.lit(".jpg?w=200#x"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.asset_key(url).alias("asset"))


@query("""SELECT p_partkey, '/i/' || p_partkey || '-' || n || '.jpg' AS url, CASE WHEN n = 1 THEN p_size * 10 END AS width FROM part, (VALUES (1), (2), (3)) v(n)""")
def srcset_explode(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    path = lambda n: F.concat(F.lit("/i/"), key, F.lit(f"-{n}.jpg"))
    value = F.concat(F.lit(" "), path(1), F.lit(" "), (F.col("p_size") * 10).cast("string"), F.lit("w , "), path(2), F.lit("  2x,"), path(3), F.lit(",,"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(urls.srcset(value)).alias("s")).select("p_partkey", "s.url", "s.width")


_NAME = "p_name || ' ' || lower(p_type)"
_DESCRIPTION = "'A ' || p_name || ' of size ' || p_size || ' by ' || p_brand"
_VIEWS = "CASE WHEN p_partkey % 4 = 0 THEN [] ELSE list_transform(range(1, p_partkey % 4 + 1), lambda i: 'https://img.example.com/p/' || p_partkey || '/view' || i || '.jpg?w=640') END"


@query(f"SELECT 'p' || p_partkey AS page_id, {_NAME} AS og_title, {_DESCRIPTION} AS description, CAST(2 AS BIGINT) AS n_meta FROM part")
def meta_first_wins(spark, sf_dir):
    m = F.col("evidence.meta")
    found = distill.harvest(standins.product_pages(spark, sf_dir), "page_id", "html")
    return found.select(F.col("id").alias("page_id"), m["og:title"].alias("og_title"), m["description"].alias("description"), F.size(F.map_keys(m)).cast("long").alias("n_meta"))


@query(f"SELECT 'p' || p_partkey AS page_id, {_NAME} AS name, p_brand AS brand, round(p_retailprice, 2) AS price, CAST(p_partkey % 4 AS BIGINT) AS n_images, CAST(3 AS BIGINT) AS n_nodes FROM part")
def jsonld_products(spark, sf_dir):
    found = distill.harvest(standins.product_pages(spark, sf_dir), "page_id", "html").withColumn("f", draft.evidence_facts(F.col("evidence")))
    nodes = distill.ld_nodes(F.get("evidence.json_ld", F.lit(0)))
    return found.select(F.col("id").alias("page_id"), "f.name", "f.brand", F.round("f.price", 2).alias("price"), F.size("f.image_urls").cast("long").alias("n_images"), F.size(nodes).cast("long").alias("n_nodes"))


_SHOWN = f"""t AS (SELECT page_id, trim({_UNESCAPED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
    {_LINES.format(_UNESCAPED.format(f"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '{_CHROME}', chr(10), 'gis'), '<[^>]*>', chr(10), 'g')"))} AS ls FROM pages)"""


@query(f"WITH {_SHOWN} SELECT page_id, title, CAST(0 AS BIGINT) AS n_ld, CAST(0 AS BIGINT) AS n_media, length({_WITHOUT_REPEATS.format('ls')}) AS n_visible FROM t")
def html_evidence(spark, sf_dir):
    e = F.col("evidence")
    found = distill.harvest(table(spark, sf_dir, "pages"), "page_id", "html")
    media_urls = F.array_distinct(F.transform(e["sightings"], lambda s: s["url"]))
    counts = {"n_ld": F.size(e["json_ld"]), "n_media": F.size(media_urls), "n_visible": F.length(e["visible_text"])}
    return found.select(F.col("id").alias("page_id"), e["title"].alias("title"), *(c.cast("long").alias(n) for n, c in counts.items()))


@query("""SELECT 'p' || p_partkey AS page_id, 'https://shop.example.com/' || p_partkey AS canonical, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS ld_name, 'state' AS source, round(4 / sqrt(6), 6) AS score,
    CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_texts,
    p_name || chr(10) || '[View of ' || p_brand || ']' || chr(10) || '[Clip]' || chr(10) || 'Costs ' || p_partkey || chr(10) || '[Price note]' || chr(10) || 'Costs ' || p_partkey AS shown FROM part""")
def page_channels(spark, sf_dir):
    e = F.col("evidence")
    found = distill.harvest(standins.rich_pages(spark, sf_dir), "page_id", "html")
    best = F.get(e["json_blobs"], F.lit(0))
    return found.select(
        F.col("id").alias("page_id"), e["canonical_url"].alias("canonical"), F.get_json_object(F.get(e["json_ld"], F.lit(0)), "$.name").alias("ld_name"), best["source"].alias("source"),
        F.round(best["score"], 6).alias("score"), F.size(e["script_texts"]).cast("long").alias("n_texts"), e["visible_text"].alias("shown"),
    )


_SEEN = """(VALUES (0, 'a.jpg?w=64', 'image', 'dom', 32, ''), (1, 'a.jpg', 'image', 'dom', 640, '.image .product.image'), (2, 'd.webp', 'image', 'dom', NULL, ''), (3, 'e.jpg', 'image', 'dom', NULL, ''),
    (4, 'v.webm', 'video', 'dom', NULL, ''), (5, 'v.mp4', 'video', 'dom', NULL, ''), (6, 'hero.jpg?quality=80', 'image', 'meta', NULL, ''), (7, 'hero.jpg', 'image', 'meta', NULL, ''),
    (8, 'b.jpg?w=100', 'image', 'json_ld', NULL, '.image'), (9, 'b.jpg', 'image', 'json_ld', NULL, ''), (10, 'c.png?width=5', 'image', 'blob', NULL, '.product.gallery.image'), (11, 'c.png', 'image', 'blob', NULL, '')) v(i, u, kind, origin, width, hint)"""


@query(f"""SELECT 'p' || p_partkey AS page, 'https://img.example.com/r/' || p_partkey || '/' || u AS url, kind, origin, width, CASE WHEN p_partkey % 11 = 0 AND i = 1 THEN '.product.image' ELSE hint END AS path_hint,
    CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS BIGINT) AS place FROM part, {_SEEN} WHERE p_partkey % 11 <> 0 OR origin <> 'json_ld'""")
def page_media(spark, sf_dir):
    seen = distill.sightings(distill.harvest(standins.rich_pages(spark, sf_dir), "page_id", "html"))
    place = F.row_number().over(standins.Window.partitionBy("page").orderBy("seq")) - 1
    return seen.select("page", "url", "kind", "origin", "width", "path_hint", place.cast("long").alias("place"))


_LABELS = f"""trim({_UNESCAPED.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")})"""


@query(f"""WITH {_SHOWN}, h AS (SELECT page_id, {_LABELS} AS h1 FROM pages), v AS (SELECT page_id, h1, title, {_WITHOUT_REPEATS.format("ls")} AS shown FROM t JOIN h USING (page_id)),
    c AS (SELECT page_id, h1, title, '== IDENTITY ==' || chr(10) || 'h1: ' || h1 || chr(10) || 'title: ' || title || chr(10) || chr(10) || '== VISIBLE TEXT ==' || chr(10) ||
        CASE WHEN length(shown) <= 10000 THEN shown ELSE left(shown, 10000) || chr(10) || '…[truncated]' END AS context FROM v)
    SELECT page_id, length(context) AS n_context, md5(context) AS digest, CAST(len({_IDENTITY.format("h1, title")}) AS BIGINT) AS n_identity FROM c""")
def distill_pages(spark, sf_dir):
    found = distill.distill(distill.harvest(table(spark, sf_dir, "pages"), "page_id", "html"))
    return found.select(F.col("id").alias("page_id"), F.length("context").cast("long").alias("n_context"), F.md5(F.col("context").cast("binary")).alias("digest"), F.size("identity").cast("long").alias("n_identity"))


# --- texts -----------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT doc_id, {_LINES.format('text')} AS ls FROM documents) SELECT doc_id, length({_WITHOUT_REPEATS.format('ls')}) AS n_chars, md5({_WITHOUT_REPEATS.format('ls')}) AS digest FROM t")
def dedupe_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.dedupe_lines(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


_SAMPLE = "lower(left(text, 100000))"


@query("SELECT doc_id, round((" + " + ".join(f"(length({_SAMPLE}) - length(replace({_SAMPLE}, '{w}', ''))) // {len(w)}" for w in text.DENSITY_WORDS) + f") / ln(length({_SAMPLE}) + 10), 6) AS density FROM documents")
def keyword_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.keyword_density(F.col("text")), 6).alias("density"))


@query("SELECT doc_id, length(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 1000) || chr(10) || '…[truncated]' END) AS n_chars, md5(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 1000) || chr(10) || '…[truncated]' END) AS digest FROM documents")
def budget_truncate(spark, sf_dir):
    t = text.fit(F.col("text"), 1000)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query("""WITH d AS (SELECT doc_id // 3 AS g, doc_id, text, 6000 - coalesce(sum(length(text)) OVER (PARTITION BY doc_id // 3 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM documents),
    k AS (SELECT g, doc_id, CASE WHEN length(text) <= rest THEN text ELSE left(text, CAST(rest AS BIGINT)) || chr(10) || '…[truncated]' END AS part FROM d WHERE rest >= 2000)
    SELECT g, length(string_agg(part, chr(10) ORDER BY doc_id)) AS n_chars, md5(string_agg(part, chr(10) ORDER BY doc_id)) AS digest FROM k GROUP BY g""")
def budget_waterfall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = docs.groupBy(F.expr("doc_id div 3").alias("g")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    out = distill.waterfall(F.transform("x", lambda r: r["text"]), 6000, 2000)
    return parts.select("g", out.alias("t")).select("g", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


_KEYS = "(SELECT DISTINCT event_type AS k FROM events UNION SELECT unnest(['consentPolicy','related-products','mainNav','cookiesManager','locale','priceRange','I18nData','NavBar','warehouse','footerLinks','skuList']))"


@query(rf"""SELECT k, replace(lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '-', '_') AS norm,
    regexp_matches(replace(lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '-', '_'), '(?:^|_)(?:{"|".join(text.NOISE_KEY_WORDS)})(?:$|_)') AS noise FROM {_KEYS}""")
def key_norm(spark, sf_dir):
    more = ["consentPolicy", "related-products", "mainNav", "cookiesManager", "locale", "priceRange", "I18nData", "NavBar", "warehouse", "footerLinks", "skuList"]
    keys = table(spark, sf_dir, "events").select(F.col("event_type").alias("k")).union(spark.createDataFrame([(k,) for k in more], "k string")).distinct()
    return keys.select("k", text.key_norm(F.col("k")).alias("norm"), text.is_noise_key(F.col("k")).alias("noise"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value, 2) AS value FROM events")
def json_prop(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round("value", 2).alias("value"))


@query("SELECT event_id, round(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END / sqrt(3), 6) AS score FROM events")
def commerce_score(spark, sf_dir):
    keys = F.array(F.lit("k"), F.lit("brandName"), F.when(F.col("event_type") == "purchase", "priceOf").otherwise("other"))
    return table(spark, sf_dir, "events").select("event_id", F.round(text.commerce_score(keys), 6).alias("score"))


_TREE = """'{"id":' || p_partkey || ',"trackingId":"x","relatedProducts":[{"name":"' || p_name || '","images":[{"u":1}],"ids":[1,2]}],"empty":"","none":null,"stock":0,"sold":false,"long":"' || repeat('z', 600) || '"}'"""


@query(f"""SELECT p_partkey, '{{"id": ' || p_partkey || ', "relatedProducts": [{{"name": "' || p_name || '", "ids": [1, 2]}}], "stock": 0, "sold": false, "long": "' || repeat('z', 500) || '…"}}' AS pruned FROM part""")
def prune_json(spark, sf_dir):
    tree = F.concat(
        F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"trackingId":"x","relatedProducts":[{"name":"'), F.col("p_name"),
        F.lit('","images":[{"u":1}],"ids":[1,2]}],"analytics":{"a":1},"empty":"","none":null,"stock":0,"sold":false,"long":"' + "z" * 600 + '"}'),
    )
    tree = F.replace(tree, F.lit('"trackingId":"x",'), F.lit('"tracking":"x",'))
    return table(spark, sf_dir, "part").select("p_partkey", jsontree.prune_json(tree).alias("pruned"))


@query("""SELECT p_partkey, '{"_columns": ["sku", "tags"], "_rows": [' || array_to_string(list_transform(range(6), lambda i: '["s' || i || '-' || p_partkey || '", "' || p_brand || '|x"]'), ', ') || ']}' AS tabulated FROM part""")
def tabulate_json(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit('{"sku":"s'), i.cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit('","tags":["'), F.col("p_brand"), F.lit('","x"]}')))
    return table(spark, sf_dir, "part").select("p_partkey", jsontree.tabulate_json(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))).alias("tabulated"))


@query("""SELECT p_partkey, p_type || ' > ' || p_brand || ' > ' || p_name AS hint FROM part""")
def breadcrumb_hint(spark, sf_dir):
    node = lambda c: F.concat(F.lit('{"@type":"ListItem","name" : "'), F.col(c), F.lit('"},'))
    body = F.concat(F.lit('{"name":"before","@type":"BreadcrumbList","x":['), node("p_type"), node("p_brand"), node("p_name"), F.lit('{"name":"x"}]}'))
    return table(spark, sf_dir, "part").select("p_partkey", text.breadcrumb_hint(body).alias("hint"))


# --- media -----------------------------------------------------------------------------------------

_MEDIA = """SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS seq,
    'https://img.example.com/p/' || (l_partkey % 50) || '/shot' || (l_linenumber % 3) || CASE WHEN q % 11 = 0 THEN '.mp4' ELSE '.jpg' END || CASE WHEN q % 2 = 0 THEN '?w=' || (q * 10) ELSE '' END AS url,
    CASE WHEN q % 11 = 0 THEN 'video' ELSE 'image' END AS kind, ['blob', 'json_ld', 'dom', 'meta'][q % 4 + 1] AS origin, CASE WHEN q % 3 = 0 THEN q * 10 END AS width,
    CASE WHEN q % 5 = 0 THEN '.relatedProducts.image' WHEN q % 7 = 0 THEN '.selectedVariant.image' ELSE '.product.image' END AS hint,
    'p/' || (l_partkey % 50) || '/shot' || (l_linenumber % 3) || CASE WHEN q % 11 = 0 THEN '-mp4' ELSE '-jpg' END AS asset FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)"""

_RANKED = f"""WITH m AS ({_MEDIA}),
    f AS (SELECT *, CASE WHEN origin IN ('blob', 'json_ld') THEN 3 WHEN origin = 'dom' THEN 2 ELSE 1 END AS q1, CASE WHEN contains(url, '?w=') THEN -1 ELSE 0 END AS q2, coalesce(width, 0) AS q3, length(string_split(url, '?')[1]) AS q4 FROM m),
    b AS (SELECT *, row_number() OVER (PARTITION BY page, kind, asset ORDER BY q1 DESC, q2 DESC, q3 DESC, q4 DESC, seq) AS br FROM f),
    g AS (SELECT page, kind, asset, least(count(DISTINCT origin), 3) AS spread, bool_and(origin IN ('blob', 'json_ld')) AS structured, min(seq) AS seq, bool_and(hint = '.relatedProducts.image') AS demoted, bool_or(hint = '.selectedVariant.image') AS boosted,
        max(CASE WHEN br = 1 THEN q1 END) AS q1, max(CASE WHEN br = 1 THEN q2 END) AS q2, max(CASE WHEN br = 1 THEN q3 END) AS q3, max(CASE WHEN br = 1 THEN q4 END) AS q4, max(CASE WHEN br = 1 THEN url END) AS url, max(CASE WHEN br = 1 THEN hint END) AS best_hint, max(CASE WHEN br = 1 THEN origin END) AS best_origin FROM b GROUP BY page, kind, asset),
    c AS (SELECT *, sum(CASE WHEN kind = 'image' AND NOT demoted THEN 1 ELSE 0 END) OVER (PARTITION BY page) AS clean, sum(CASE WHEN kind = 'image' AND boosted THEN 1 ELSE 0 END) OVER (PARTITION BY page) AS nb FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY NOT demoted DESC, boosted DESC, spread DESC, q1 DESC, q2 DESC, q3 DESC, q4 DESC, seq) - 1 AS rank FROM c
        WHERE NOT (kind = 'image' AND ((demoted AND clean >= 3) OR (nb >= 3 AND NOT boosted AND structured))))"""


@query(f"{_RANKED} SELECT page, kind, asset, CAST(rank AS BIGINT) AS rank, url, demoted, boosted, CAST(spread AS BIGINT) AS spread FROM r WHERE (kind = 'image' AND rank < 40) OR (kind = 'video' AND rank < 5)")
def media_rank_topk(spark, sf_dir):
    kept = media.ranked(standins.media_rows(spark, sf_dir))
    return kept.select("page", "kind", "asset", F.col("rank").cast("long").alias("rank"), "url", "demoted", "boosted", F.col("spread").cast("long").alias("spread"))


@query(f"""{_RANKED}, n AS (SELECT page, kind, rank, CASE WHEN kind = 'image' THEN 'IMG_' ELSE 'VID_' END || rank || ' ' || url || CASE WHEN best_hint = '.selectedVariant.image' THEN ' [selected product]' WHEN best_hint = '.relatedProducts.image' THEN ' [related items rail]' WHEN best_origin = 'meta' THEN ' [page hero]'
        WHEN best_origin IN ('blob', 'json_ld') THEN ' [product data]' ELSE '' END AS line FROM r WHERE (kind = 'image' AND rank < 40) OR (kind = 'video' AND rank < 5))
    SELECT page, CAST(count(*) FILTER (kind = 'image') AS BIGINT) AS n_images, CAST(count(*) FILTER (kind = 'video') AS BIGINT) AS n_videos, string_agg(line, chr(10) ORDER BY kind, rank) AS listing FROM n GROUP BY page""")
def media_listing(spark, sf_dir):
    shown = media.per_page(media.ranked(standins.media_rows(spark, sf_dir)))
    return shown.select("page", F.size("images").cast("long").alias("n_images"), F.size("videos").cast("long").alias("n_videos"), F.col("rendered").alias("listing"))


@query(f"""WITH m AS ({_MEDIA}), h AS (SELECT page, url, hint, min(seq) AS first_seq FROM m GROUP BY ALL), j AS (SELECT page, url, string_agg(hint, ' ' ORDER BY first_seq) AS path_hint FROM h GROUP BY ALL)
    SELECT page, url, min_by(kind, seq) AS kind, min_by(origin, seq) AS origin, max(width) AS width, any_value(path_hint) AS path_hint, CAST(min(seq) AS BIGINT) AS seq FROM m JOIN j USING (page, url) GROUP BY page, url""")
def media_merge(spark, sf_dir):
    merged = media.merged_sightings(standins.media_rows(spark, sf_dir))
    return merged.select("page", "url", "kind", "origin", "width", "path_hint", F.col("seq").cast("long").alias("seq"))


# --- search ----------------------------------------------------------------------------------------

_STEM = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END))"
_PATHS = f"""paths AS (SELECT path, len(string_split(path, '>')) - 1 AS depth, {_STEM.format("path")} AS words, {_STEM.format("string_split(path, '>')[-1]")} AS leaf FROM
    (SELECT p_type || ' > ' || p_brand || ' > ' || p_name AS path FROM part UNION SELECT p_type FROM part))"""
_ASKED = "asked AS (SELECT DISTINCT p_name || ' ' || p_type AS q FROM part)"
_LEXICAL = f"""{_PATHS}, {_ASKED}, w AS (SELECT q, {_STEM.format("q")} AS words FROM asked),
    s AS (SELECT q, path, len(list_intersect(w.words, p.words)) + 1.5 * len(list_intersect(list_intersect(w.words, p.words), leaf)) + 0.05 * depth AS score FROM w, paths p WHERE len(list_intersect(w.words, p.words)) > 0),
    lexical AS (SELECT q, path, CAST(round(score, 6) AS DOUBLE) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, path DESC) AS rank FROM s QUALIFY rank <= 20)"""


def _asked(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = F.concat_ws(" ", "p_name", "p_type")
    return part.select(q.alias("q"), q.alias("text")).distinct()


@query(f"WITH {_LEXICAL} SELECT q, path, score, CAST(rank AS BIGINT) AS rank FROM lexical")
def lexical_topk(spark, sf_dir):
    found = taxonomy.lexical_topk(_asked(spark, sf_dir), taxonomy.prepared(standins.taxonomy(spark, sf_dir)), 20)
    return found.select("q", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_VECTOR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    c AS (SELECT a.vec_id AS q, b.vec_id AS path, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-9) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
    vector AS (SELECT q, path, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, path) AS rank FROM c QUALIFY rank <= 50)"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q"), "embedding"), rows.select(F.col("vec_id").alias("path"), "embedding")


def _ranked_vectors(found):
    return found.select("q", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VECTOR} SELECT q, path, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM vector")
def vector_topk(spark, sf_dir):
    return _ranked_vectors(vectors.vector_topk(*_vectors(spark, sf_dir)))


@query(f"WITH {_VECTOR} SELECT q, path, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM vector")
def vector_lists(spark, sf_dir):
    """Through inverted lists, of which every query asks all, so that the result is exact; tests measure the recall of fewer."""
    asked, known = _vectors(spark, sf_dir)
    lists = vectors.train_lists(known)
    return _ranked_vectors(vectors.list_topk(asked, vectors.with_lists(known, lists), lists, probes=len(lists.centroids)))


_HASHED = """list_transform(range(32), lambda i: CAST(list_sum(list_transform(list_filter(list_transform({}, lambda w: CAST('0x' || md5(w)[1:8] AS BIGINT)), lambda n: n % 32 = i), lambda n: CASE WHEN (n // 32) % 2 = 0 THEN 1 ELSE -1 END)) AS DOUBLE))"""
_FILLED = "list_transform({}, lambda x: coalesce(x, 0.0))"
_SEMANTIC = f"""qv AS (SELECT q, {_FILLED.format(_HASHED.format("words"))} AS e FROM w), pv AS (SELECT path, {_FILLED.format(_HASHED.format("words"))} AS e FROM paths),
    sims AS (SELECT q, path, round(list_dot_product(qv.e, pv.e) / (sqrt(list_dot_product(qv.e, qv.e)) * sqrt(list_dot_product(pv.e, pv.e)) + 1e-9), 12) AS sim FROM qv, pv),
    semantic AS (SELECT q, path, row_number() OVER (PARTITION BY q ORDER BY sim DESC, path) AS rank FROM sims QUALIFY rank <= 5)"""
_UNION = """SELECT q, path, CAST(row_number() OVER (PARTITION BY q ORDER BY place, path) - 1 AS BIGINT) AS idx FROM (SELECT q, path, min(part * 1000000 + rank) AS place FROM (
    SELECT q, path, 0 AS part, rank FROM lexical JOIN paths USING (path) WHERE depth > 0 AND rank <= {} UNION ALL SELECT q, path, 1, rank FROM semantic UNION ALL
    SELECT q, path, 2, row_number() OVER (PARTITION BY q ORDER BY path) FROM asked, paths WHERE depth = 0) u GROUP BY q, path) d"""


@query(f"WITH {_LEXICAL}, {_SEMANTIC} {_UNION.format(20)}")
def union_shortlist(spark, sf_dir):
    paths, asked = taxonomy.prepared(standins.taxonomy(spark, sf_dir)), _asked(spark, sf_dir)
    nearest = taxonomy.embedding_ranker(paths, vectors.hashing_embedder())(asked, 5)
    return taxonomy.union_shortlist(taxonomy.lexical_topk(asked, paths, 20), nearest, asked, paths).select("q", "path", F.col("idx").cast("long").alias("idx"))


@query(f"""WITH {_LEXICAL} SELECT q, path AS category FROM lexical WHERE rank = 1""")
def category_resolve(spark, sf_dir):
    paths = taxonomy.prepared(standins.taxonomy(spark, sf_dir))
    return taxonomy.resolved(_asked(spark, sf_dir), paths, taxonomy.embedding_ranker(paths, vectors.hashing_embedder()))


@query(f"""WITH {_LEXICAL}, {_SEMANTIC}, wanted AS (SELECT p_name || ' ' || p_type AS q, min(p_type || ' > ' || p_brand || ' > ' || p_name) AS path FROM part GROUP BY 1),
    one AS (SELECT * FROM ({_UNION.format(2)}) JOIN wanted USING (q, path)), two AS (SELECT * FROM ({_UNION.format(6)}) JOIN wanted USING (q, path))
    SELECT q, path AS category, CAST(1 AS BIGINT) AS attempt, idx FROM one UNION ALL SELECT q, path, 2, idx FROM two WHERE q NOT IN (SELECT q FROM one)""")
def category_retry(spark, sf_dir):
    """A picker that takes one path only: drafts whose first shortlist lacks it get a longer one, and some never find it."""
    paths = taxonomy.prepared(standins.taxonomy(spark, sf_dir))
    part = table(spark, sf_dir, "part")
    wanted = part.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("q")).agg(F.min(F.concat_ws(" > ", "p_type", "p_brand", "p_name")).alias("wanted"))
    picker = lambda shortlists: shortlists.join(wanted, "q").select("q", (F.array_position("options", F.col("wanted")) - 1).alias("idx"))
    ranker = taxonomy.embedding_ranker(paths, vectors.hashing_embedder())
    found = taxonomy.picked(_asked(spark, sf_dir), paths, ranker, picker, sizes=(2, 6), k_vector=5)
    return found.select("q", "category", F.col("attempt").cast("long").alias("attempt"), F.col("idx").cast("long").alias("idx"))


_DRAFTED = f"""{_PATHS}, asked AS (SELECT p_partkey, {_STEM.format(f"concat_ws(' ', {_NAME}, {_DESCRIPTION}, p_brand, 'home')")} AS own FROM part),
    s AS (SELECT p_partkey, path, len(list_intersect(own, words)) + 1.5 * len(list_intersect(list_intersect(own, words), leaf)) + 0.05 * depth AS score FROM asked, paths WHERE len(list_intersect(own, words)) > 0),
    best AS (SELECT p_partkey, path FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, path DESC) = 1)"""


@query(f"""WITH {_DRAFTED} SELECT 'p' || p_partkey AS id, {_NAME} AS name, round(p_retailprice, 2) AS price, CASE WHEN p_partkey % 7 = 0 THEN 'JPY' ELSE 'USD' END AS currency, {_DESCRIPTION} AS description,
    CAST(p_partkey % 4 AS BIGINT) AS n_images, path AS category, p_brand AS brand FROM part JOIN best USING (p_partkey)""")
def extract_products(spark, sf_dir):
    contexts = materialized(distill.distill(distill.harvest(standins.product_pages(spark, sf_dir), "page_id", "html")))
    made = draft.extract_products(contexts, taxonomy.prepared(standins.taxonomy(spark, sf_dir)))
    return made.select("id", "name", F.round("price.price", 2).alias("price"), "price.currency", "description", F.size("image_urls").cast("long").alias("n_images"), F.col("category.name").alias("category"), "brand")


# --- catalog ---------------------------------------------------------------------------------------


@query(f"""SELECT 'p' || p_partkey AS id, {_NAME} AS name, p_brand AS brand, p_retailprice AS price, ({_VIEWS})[1] AS image_url, ({_VIEWS})[2] AS hover_image_url, p_type || ' > ' || p_brand || ' > ' || p_name AS category,
    CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'assignment' ELSE 'unseen' END AS source FROM part""")
def catalog_summary(spark, sf_dir):
    graded = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"))
    found = catalog.summaries(standins.products(spark, sf_dir), graded)
    return found.withColumn("price", F.col("price.price"))


@query(f"SELECT 'p' || p_partkey AS id, {_NAME} AS name, p_brand AS brand FROM part WHERE contains(lower({_NAME} || ' ' || p_brand), 'ring')")
def catalog_search(spark, sf_dir):
    return catalog.search(catalog.summaries(standins.products(spark, sf_dir)), "  RING ").select("id", "name", "brand")


@query(f"SELECT 'p' || p_partkey AS id, {_NAME} AS name, {_DESCRIPTION} AS description FROM part WHERE p_partkey = 77")
def catalog_lookup(spark, sf_dir):
    return catalog.lookup(standins.products(spark, sf_dir), "p77").select("id", "name", "description")


@query(f"""SELECT 'p' || p_partkey AS id, {_NAME} || CASE WHEN p_partkey % 10 = 0 THEN ' II' ELSE '' END AS name, p_retailprice AS price FROM part WHERE p_partkey % 17 <> 0""")
def catalog_store(spark, sf_dir):
    """Put in, updated, thinned out and read back."""
    products, key = standins.products(spark, sf_dir), F.substring("id", 2, 20).cast("long")
    store = CatalogStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.upsert(products)
    store.upsert(products.filter(key % 10 == 0).withColumn("name", F.concat("name", F.lit(" II"))))
    store.remove(products.filter(key % 17 == 0).select("id"))
    return store.read().select("id", "name", F.col("price.price").alias("price"))


_CODES = "[" + ", ".join(f"'{c}'" for c, _, _ in catalog.CURRENCIES) + ", 'XTS', NULL, ' eur ']"
_DIMENSION = ", ".join(f"('{c}', {d}, '{s}')" for c, d, s in catalog.CURRENCIES)


@query(f"""WITH a AS (SELECT p_partkey, p_retailprice * 10 + 0.125 AS amount, ({_CODES})[p_partkey % {len(catalog.CURRENCIES) + 3} + 1] AS code FROM part),
    j AS (SELECT a.*, digits, symbol FROM a LEFT JOIN (VALUES {_DIMENSION}) d(known, digits, symbol) ON known = upper(trim(code)))
    SELECT p_partkey, CASE digits WHEN 0 THEN symbol || format('{{:,.0f}}', round(amount, 0)) WHEN 3 THEN symbol || format('{{:,.3f}}', round(amount, 3)) WHEN 2 THEN symbol || format('{{:,.2f}}', round(amount, 2))
        ELSE concat_ws(' ', format('{{:,.2f}}', round(amount, 2)), upper(trim(code))) END AS price_label FROM j""")
def price_labels(spark, sf_dir):
    codes = F.array(*(F.lit(c) for c, _, _ in catalog.CURRENCIES), F.lit("XTS"), F.lit(None), F.lit(" eur "))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 10 + 0.125).alias("amount"), F.get(codes, (F.col("p_partkey") % (len(catalog.CURRENCIES) + 3)).cast("int")).alias("code"))
    return catalog.with_price_label(rows, catalog.currencies(spark), F.col("amount"), F.col("code")).select("p_partkey", "price_label")


@query(f"SELECT 'p' || p_partkey AS id, {_NAME} AS name, p_brand AS brand FROM part WHERE contains(lower({_NAME} || ' ' || p_brand), 'ring')")
def catalog_trigrams(spark, sf_dir):
    rows = catalog.summaries(standins.products(spark, sf_dir)).select("id", "name", "brand")
    value = F.concat_ws(" ", "name", "brand")
    index = search.write_index(rows, value, f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}")
    return search.substring_search(rows, value, index, "  RING ")


@query("""SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) AS BIGINT) AS n_assignment,
    CAST(count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS BIGINT) AS n_unseen FROM part""")
def catalog_counts(spark, sf_dir):
    return catalog.source_counts(catalog_summary(spark, sf_dir))


@query("""SELECT 'p' || p_partkey AS id, p_partkey % 5 = 0 AS on_sale, CASE WHEN p_partkey % 5 = 0 THEN CAST(floor((1 - p_retailprice / (p_retailprice * 1.25)) * 100 + 0.5) AS BIGINT) END AS percent_off FROM part""")
def sale_pct(spark, sf_dir):
    p = F.col("price")
    return standins.products(spark, sf_dir).select("id", catalog.on_sale(p["price"], p["compare_at_price"]).alias("on_sale"), catalog.percent_off(p["price"], p["compare_at_price"]).alias("percent_off"))


@query(f"""SELECT 'p' || p_partkey AS id, p_name AS leaf, string_split(p_name, ' ')[1] AS colors_text, CAST(p_partkey % 4 AS BIGINT) AS n_slides, left(p_brand, 1) AS initial, 'size ' || p_size || '; kind ' || lower(p_type) AS features FROM part""")
def page_view(spark, sf_dir):
    seen = catalog.page_view(standins.products(spark, sf_dir))
    return seen.select("id", "leaf", "colors_text", F.size("slides").cast("long").alias("n_slides"), "initial", F.array_join("features", "; ").alias("features"))


_VARIANTS = """v AS (SELECT 'p' || l_partkey AS id, l_returnflag AS flag, l_linestatus AS status, max(l_extendedprice) AS price, bool_or(l_quantity > 25) AS stock FROM lineitem GROUP BY ALL),
    o AS (SELECT id, count(*) AS n, count(DISTINCT flag) AS nf, count(DISTINCT status) AS ns FROM v GROUP BY id)"""


def _chosen(**values):
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v)))) if values else F.create_map().cast("map<string,string>")


@query(f"WITH {_VARIANTS} SELECT o.id, v.flag || '-' || v.status AS sku, v.price, v.stock AS available FROM o LEFT JOIN v ON v.id = o.id AND flag = 'R' AND status = 'F'")
def resolve_variant(spark, sf_dir):
    found = standins.variant_rows(spark, sf_dir).withColumn("v", variants.resolve(F.col("variants"), _chosen(Flag="R", Status="F")))
    return found.select("id", "v.sku", "v.price", "v.available")


@query(f"WITH {_VARIANTS} SELECT id, CAST(count(*) FILTER (flag = 'A') AS BIGINT) AS n_matches, CASE WHEN count(*) FILTER (flag = 'A') > 0 THEN 'https://img.example.com/v/A.jpg' ELSE '' END AS images FROM v GROUP BY id")
def variant_images(spark, sf_dir):
    chosen = _chosen(Flag="A")
    matching = F.filter("variants", lambda v: variants.matches(v, chosen))
    return standins.variant_rows(spark, sf_dir).select("id", F.size(matching).cast("long").alias("n_matches"), F.array_join(variants.images(F.col("variants"), chosen), " ").alias("images"))


@query(f"WITH {_VARIANTS} SELECT id, CAST(nf * ns AS BIGINT) AS combinations, n / (nf * ns) >= 0.6 AS dense FROM o")
def variant_density(spark, sf_dir):
    return standins.variant_rows(spark, sf_dir).select("id", variants.combinations(F.col("options")).alias("combinations"), variants.dense(F.col("variants"), F.col("options")).alias("dense"))


@query(f"""WITH {_VARIANTS} SELECT o.id, n / (nf * ns) >= 0.6 AND NOT EXISTS (SELECT 1 FROM v WHERE v.id = o.id AND flag = 'N' AND status = 'F') AS disabled,
    CASE WHEN n / (nf * ns) >= 0.6 THEN 'Status' ELSE '' END AS axis FROM o""")
def value_disabled(spark, sf_dir):
    rows = standins.variant_rows(spark, sf_dir)
    v, o = F.col("variants"), F.col("options")
    return rows.select("id", variants.disabled(v, o, _chosen(Flag="N"), F.lit("Status"), F.lit("F")).alias("disabled"), F.when(variants.dense(v, o), "Status").otherwise("").alias("axis"))


@query(f"""WITH {_VARIANTS}, b AS (SELECT DISTINCT id, 'Flag' AS axis, flag AS value, flag AS f, 'F' AS s FROM v UNION ALL SELECT DISTINCT id, 'Status', status, 'R', status FROM v)
    SELECT b.id, axis, value, value = CASE axis WHEN 'Flag' THEN 'R' ELSE 'F' END AS selected,
    value <> CASE axis WHEN 'Flag' THEN 'R' ELSE 'F' END AND n / (nf * ns) >= 0.6 AND v.id IS NULL AS disabled
    FROM b JOIN o ON o.id = b.id LEFT JOIN v ON v.id = b.id AND v.flag = b.f AND v.status = b.s""")
def value_buttons(spark, sf_dir):
    return variants.buttons(standins.variant_rows(spark, sf_dir), _chosen(Flag="R", Status="F"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) AND p_partkey % 3 <> 0 THEN 'a.jpg' WHEN p_partkey % 5 IN (1, 2) THEN 'b.jpg' END AS src,
    CASE WHEN NOT (p_partkey % 5 IN (0, 1) AND p_partkey % 3 <> 0) AND p_partkey % 5 NOT IN (1, 2) THEN left(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END, 1) END AS initial FROM part""")
def card_images(spark, sf_dir):
    key = F.col("p_partkey")
    image, hover = F.when((key % 5).isin(0, 1), "a.jpg"), F.when((key % 5).isin(1, 2), "b.jpg")
    dead = F.when(key % 3 == 0, F.array(F.lit("a.jpg")))
    return table(spark, sf_dir, "part").select("p_partkey", catalog.card_image(image, hover, F.when(key % 2 == 0, F.col("p_brand")), F.col("p_name"), dead).alias("card")).select("p_partkey", "card.*")


# --- drafts ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS shown FROM orders""")
def price_provenance(spark, sf_dir):
    price = F.col("o_totalprice")
    two = text.two_decimals(price)
    shown = F.when(F.col("o_orderkey") % 4 == 0, two).when(F.col("o_orderkey") % 4 == 1, F.replace(two, F.lit("."), F.lit(","))).when(F.col("o_orderkey") % 4 == 2, F.replace(two, F.lit("."), F.lit("")))
    context = F.concat(F.lit("now only "), F.coalesce(shown, F.lit("ask us")), F.lit(" !"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.on_page(price, context).alias("shown"))


@query("""SELECT o_orderkey, o_orderkey % 5 <> 0 AS in_range, CASE WHEN o_orderkey % 5 = 0 THEN 'a' ELSE 'a b' END AS picked FROM orders""")
def resolve_index(spark, sf_dir):
    ids = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(0), F.lit(-1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    pool = F.array(F.lit("a"), F.lit("b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (~F.exists(ids, lambda i: (i < 0) | (i >= 2))).alias("in_range"), F.array_join(draft.at_indices(pool, ids), " ").alias("picked"))


@query("""SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 4 = 3 THEN 'price ' || printf('%g', o_totalprice) || ' is not on the page' END, CASE WHEN o_orderkey % 5 = 0 THEN 'image ids must be 0 to 1' END,
    CASE WHEN o_orderkey % 5 = 1 THEN 'no images were chosen though there are candidates' END) AS problems FROM orders""")
def draft_problems(spark, sf_dir):
    """All checks of a draft: a price that the page shows or not, image ids in and out of range, no image chosen."""
    k, two = F.col("o_orderkey"), text.two_decimals(F.col("o_totalprice"))
    ids = F.when(k % 5 == 0, F.array(F.lit(0), F.lit(-1), F.lit(2))).when(k % 5 == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(1)))
    made = F.struct(F.col("o_totalprice").alias("price"), F.lit(None).cast("double").alias("compare_at_price"), ids.alias("image_ids"))
    context = F.when(k % 4 == 3, "ask us").otherwise(F.concat(F.lit("now only "), two))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(draft.problems(made, context, F.lit(2)), "; ").alias("problems"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempt, doc_id % 10 = 9 AS dead FROM documents")
def retry_ladder(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    contexts = docs.select(F.col("doc_id").alias("id"), F.lit("only 5.00 here").alias("context"), F.array(F.lit("u")).alias("images"), F.array().cast("array<string>").alias("videos"))

    def drafter(rows: DataFrame) -> DataFrame:
        bad = (F.col("id") % 10 == 9) | ((F.col("id") % 3 == 0) & F.col("repair").isNull())
        made = F.struct(F.when(bad, 7.0).otherwise(5.0).alias("price"), F.lit(None).cast("double").alias("compare_at_price"), F.array(F.lit(0)).alias("image_ids"))
        return rows.withColumn("draft", made)

    good, dead = draft.drafted(contexts, [drafter, drafter, drafter])
    rows = good.select(F.col("id").alias("doc_id"), "attempt", F.lit(False).alias("dead"))
    return rows.unionByName(dead.select(F.col("id").alias("doc_id"), F.lit(None).cast("int").alias("attempt"), F.lit(True).alias("dead")))


@query("""WITH u AS (SELECT CASE WHEN role = 'user' THEN 'small' WHEN role = 'assistant' THEN 'large' ELSE 'unknown' END AS model, CAST(length(text) // 4 AS BIGINT) AS i, CAST(length(text) // 8 AS BIGINT) AS o FROM conversations),
    c AS (SELECT model, i, o, CASE model WHEN 'small' THEN (i * 0.1 + o * 0.4) / 1000000 WHEN 'large' THEN (i * 2.0 + o * 8.0) / 1000000 ELSE 0 END AS cost FROM u)
    SELECT model, CAST(count(*) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(cost), 9) AS cost, round(avg(cost) * 1000000, 3) AS at_1m FROM c GROUP BY model""")
def usage_cost(spark, sf_dir):
    n = F.length("text")
    model = F.when(F.col("role") == "user", "small").when(F.col("role") == "assistant", "large").otherwise("unknown")
    calls = table(spark, sf_dir, "conversations").select(model.alias("model"), F.floor(n / 4).alias("input_tokens"), F.floor(n / 8).alias("output_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"))
    prices = spark.createDataFrame([("small", 0.1, 0.4), ("large", 2.0, 8.0)], "model string, input double, output double")
    out = usage.totals(usage.costed(calls, prices))
    return out.select("model", "calls", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"), F.round("at_1m", 3).alias("at_1m"))


# --- evaluation ------------------------------------------------------------------------------------

_SCORES = """s AS (SELECT 'p' || p_partkey AS id, p_partkey % 10 = 9 AS gone,
        CASE WHEN p_partkey % 3 = 1 THEN 0.0 ELSE 1.0 END AS name,
        CASE WHEN p_partkey % 4 = 2 THEN 0.0 ELSE 0.5 END + CASE WHEN p_partkey % 6 = 1 THEN 0.0 ELSE 0.25 END + CASE WHEN p_partkey % 5 = 3 THEN 0.0 ELSE 0.25 END AS price,
        CASE WHEN p_partkey % 8 = 5 THEN 1 / 4 ELSE 1.0 END AS descr, CASE WHEN p_partkey % 7 = 2 THEN 0.5 ELSE 1.0 END AS feat,
        CASE WHEN p_partkey % 4 = 0 THEN 1.0 WHEN p_partkey % 9 = 4 THEN round_even(2 / (1 + p_partkey % 4), 2) ELSE 1.0 END AS imgs, CASE WHEN p_partkey % 11 = 1 THEN 0.0 ELSE 1.0 END AS video,
        CASE WHEN p_partkey % 6 = 5 THEN 0.5 WHEN p_partkey % 6 = 4 THEN 0.0 ELSE 1.0 END AS cat, CASE WHEN p_partkey % 5 = 2 THEN 0.67 ELSE 1.0 END AS colors, 1.0 AS variants FROM part),
    z AS (SELECT id, CASE WHEN gone THEN 0.0 ELSE name END AS name, CASE WHEN gone THEN 0.0 ELSE price END AS price, CASE WHEN gone THEN 0.0 ELSE descr END AS "desc", CASE WHEN gone THEN 0.0 ELSE feat END AS feat, CASE WHEN gone THEN 0.0 ELSE imgs END AS imgs,
        CASE WHEN gone THEN 0.0 ELSE video END AS video, CASE WHEN gone THEN 0.0 ELSE cat END AS cat, CASE WHEN gone THEN 0.0 ELSE colors END AS colors, CASE WHEN gone THEN 0.0 ELSE variants END AS variants FROM s)"""
_SCORED = evaluate.FIELDS
_MEAN = "(" + " + ".join(f'"{f}"' for f in _SCORED) + f") / {len(_SCORED)}"


def _scores(spark, sf_dir):
    truth = standins.products(spark, sf_dir)
    return evaluate.field_scores(truth.withColumn("variants", F.lit("[]")), standins.altered(truth))


@query(f"WITH {_SCORES} SELECT id, {', '.join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in _SCORED)} FROM z")
def field_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", *_SCORED)


@query(f"""WITH {_SCORES}, m AS (SELECT {', '.join(f'avg("{f}") AS "{f}"' for f in _SCORED)} FROM z)
    SELECT {', '.join(f'round("{f}", 6) AS "{f}"' for f in _SCORED)}, round({_MEAN}, 6) AS overall, {_MEAN} >= 0.999 AS passes FROM m""")
def scoreboard(spark, sf_dir):
    board = evaluate.scoreboard(_scores(spark, sf_dir))
    return board.select(*(F.round(f, 6).alias(f) for f in (*_SCORED, "overall")), "passes")


@query(f"""WITH {_SCORES} SELECT id, round({_MEAN}, 6) AS mean, array_to_string(list_filter([{", ".join(f"""CASE WHEN "{f}" < 1 THEN '{f}' END""" for f in _SCORED)}], lambda x: x IS NOT NULL), ',') AS misses FROM z""")
def page_scores(spark, sf_dir):
    found = evaluate.page_means(_scores(spark, sf_dir))
    return found.select("id", F.round("mean", 6).alias("mean"), F.array_join("misses", ",").alias("misses"))


_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split({_NORM.format("text")}, ' '), lambda x: x <> '')) AS ws FROM benchmark),
    p AS (SELECT a.item_id, a.ws AS x, b.ws AS y FROM w a JOIN w b ON b.item_id = a.item_id + 1), r AS (SELECT item_id, len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE AS share FROM p)
    SELECT item_id, CASE WHEN share >= 0.7 THEN 1.0 ELSE round_even(share, 2) END AS score FROM r""")
def score_text(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return rows.join(after, "item_id").select("item_id", evaluate.text_score(F.col("text"), F.col("other")).alias("score"))


@query(f"""WITH {_VARIANTS}, t AS (SELECT id, count(*) AS n, count(*) FILTER (flag <> 'A') AS kept, count(*) FILTER (flag = 'R') AS wrong FROM v GROUP BY id)
    SELECT id, round_even(kept / n * 0.5 + CASE WHEN kept > 0 THEN 0.25 ELSE 0 END + CASE WHEN kept > 0 THEN (kept - 0.25 * wrong) / kept ELSE 0 END * 0.25, 2) AS score FROM t""")
def score_variants(spark, sf_dir):
    rows = standins.variant_rows(spark, sf_dir)
    some = F.filter("variants", lambda v: v["selections"][0]["value"] != "A")
    wrong = F.transform(some, lambda v: v.withField("available", F.when(v["selections"][0]["value"] == "R", ~v["available"]).otherwise(v["available"])))
    return rows.select("id", evaluate.variant_score(F.to_json("variants"), wrong).alias("score"))


_BENCH = """e AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN ['good'] ELSE ['bad', 'poor'] END AS accepted, toxic = 1 AS graded FROM labels), o AS (SELECT doc_id AS id, CASE WHEN n_chars % 2 = 0 THEN 'good' WHEN n_chars % 3 = 0 THEN 'poor' ELSE 'bad' END AS predicted FROM documents WHERE doc_id % 7 <> 0),
    b AS (SELECT e.id, predicted, accepted, coalesce(list_contains(accepted, predicted), false) AS correct, graded FROM e LEFT JOIN o USING (id))"""


def _bench(spark, sf_dir):
    """Labels as expectations, documents as answers; every seventh answer is missing on purpose."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    expected = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array(F.lit("bad"), F.lit("poor"))).alias("accepted"))
    out = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 2 == 0, "good").when(F.col("n_chars") % 3 == 0, "poor").otherwise("bad").alias("category"))
    return evaluate.category_bench(expected, out, labels.filter("toxic = 1").select(F.col("doc_id").alias("id")))


@query(f"""WITH {_BENCH} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (correct) AS BIGINT) AS n_correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy, CAST(count(*) FILTER (graded) AS BIGINT) AS n_graded,
        round(coalesce(count(*) FILTER (graded AND correct) / nullif(count(*) FILTER (graded), 0), 0), 6) AS graded_accuracy FROM b""")
def category_accuracy(spark, sf_dir):
    found = evaluate.accuracy(_bench(spark, sf_dir))
    return found.select("n", "n_correct", F.round("accuracy", 6).alias("accuracy"), "n_graded", F.round("graded_accuracy", 6).alias("graded_accuracy"))


@query(f"WITH {_BENCH} SELECT id, predicted, array_to_string(accepted, ' | ') AS accepted FROM b WHERE NOT correct")
def wrong_pages(spark, sf_dir):
    return evaluate.wrong_pages(_bench(spark, sf_dir))


@query("SELECT l.doc_id AS id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def missing_truth_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return evaluate.unexpected(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), docs)


@query("""SELECT 'p' || p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 1 THEN 'name' END, CASE WHEN p_partkey % 3 = 0 THEN 'brand' END, CASE WHEN p_partkey % 5 = 1 AND string_split(p_name, ' ')[1] = lower(p_type) THEN 'feature word ' || lower(p_type) END, CASE WHEN p_partkey % 5 = 1 THEN 'color ' || string_split(p_name, ' ')[1] END, CASE WHEN p_partkey % 4 > 1 THEN 'image p/' || p_partkey || '/view2-jpg' END,
    CASE WHEN p_partkey % 4 > 2 THEN 'image p/' || p_partkey || '/view3-jpg' END], lambda x: x IS NOT NULL), '; ') AS missing FROM part""")
def reachability(spark, sf_dir):
    rows = standins.products(spark, sf_dir).withColumn("variants", F.lit("[]")).withColumn("colors", F.transform("colors", lambda c: F.concat(F.lit("c"), c)))
    key = F.substring("id", 2, 20).cast("long")
    rows = rows.withColumn("colors", F.transform("colors", lambda c: F.substring(c, 2, 30)))
    p = F.col("price")
    shown = F.concat_ws(" ", "name", "description", F.array_join("key_features", " "), F.format_string("%.2f", p["price"]), F.coalesce(text.two_decimals(p["compare_at_price"]), F.lit("")))
    shown = F.when(key % 3 == 0, F.replace(shown, F.col("brand"), F.lit("-"))).otherwise(shown)
    shown = F.when(key % 5 == 1, F.replace(F.replace(shown, F.get("colors", F.lit(0)), F.lit("~")), F.lit("~ "), F.lit(""))).otherwise(shown)
    known = F.array(F.concat(F.lit("p/"), key.cast("string"), F.lit("/view1-jpg")))
    found = evaluate.unreachable(F.struct(*(c for c in rows.columns if c != "id")), shown, known)
    return rows.select("id", F.array_join(found, "; ").alias("missing"))


@query("""WITH w AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), f AS (SELECT DISTINCT doc_id, ws[i] AS fact, t FROM w, (VALUES (1), (10), (60), (200), (700)) v(i) WHERE len(ws) >= i),
    e AS (SELECT doc_id, fact, strpos(t, lower(fact)) + length(fact) - 1 AS e1, strpos(left(t, 400), lower(fact)) AS at2, length(fact) AS n FROM f),
    m AS (SELECT doc_id, fact, CASE WHEN e1 <= 500 THEN 1 WHEN e1 <= 1000 THEN 2 WHEN e1 <= 2000 THEN 4 WHEN e1 <= 4000 THEN 8 END AS s1, CASE WHEN at2 = 0 THEN NULL WHEN at2 + n - 1 <= 100 THEN 1 WHEN at2 + n - 1 <= 200 THEN 2 WHEN at2 + n - 1 <= 400 THEN 4 END AS s2 FROM e)
    SELECT doc_id, fact, CAST(least(s1, s2) AS DOUBLE) AS scale FROM m""")
def reach_budgets(spark, sf_dir):
    """Words of each document as facts, its text and its beginning as two channels, four scales of their budgets."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    facts = docs.select("id", F.explode(text.bound(words, lambda ws: F.array_compact(F.array(*(F.get(ws, F.lit(i - 1)) for i in (1, 10, 60, 200, 700)))))).alias("fact")).distinct()
    channels = docs.withColumn("budget", F.lit(500)).unionByName(docs.select("id", F.left("text", F.lit(400)).alias("text"), F.lit(100).alias("budget")))
    return evaluate.least_budgets(facts, channels, (1, 2, 4, 8)).withColumnRenamed("id", "doc_id")


# --- extensions ------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey, o_orderdate, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice) AS before FROM orders)
    SELECT o_custkey AS url, o_orderdate AS ts, before, o_totalprice AS price FROM o WHERE before <> o_totalprice""")
def price_change(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return ingest.price_changes(seen)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 30 MINUTE AS last_ts, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_refresh(spark, sf_dir):
    found = ingest.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("first_ts"), F.col("session.end").cast("timestamp_ntz").alias("last_ts"), "n")
