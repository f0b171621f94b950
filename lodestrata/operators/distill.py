"""Evidence to context: anchored to the page's own product, pruned, and cut to a budget for each channel."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import html, jsontree, text
from lodestrata.functions.arrow import over_values
from lodestrata.functions.materialize import materialized
from lodestrata.operators import media


@dataclass(frozen=True)
class Budgets:
    """Characters of each channel, and how many blobs, scripts and media count."""

    json_ld: int = 20_000
    meta: int = 2_000
    blobs: int = 58_000
    scripts: int = 8_000
    visible: int = 10_000
    n_blobs: int = 3
    n_scripts: int = 2
    least_left: int = 2_000
    images: int = media.MOST_IMAGES
    videos: int = media.MOST_VIDEOS


PRODUCT_TYPES = ("Product", "ProductGroup")


def harvest(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, evidence: all that a page says of its product; the shape is schemas.EVIDENCE.

    The parts are expressions over the page's nodes, so those that aren't selected are not worked out: titles alone cost a parse.
    """
    n = F.col("nodes")
    base = pages.select(F.col(id_col).alias("id"), html.page_nodes(F.col(html_col)).alias("nodes"))
    read = base.select(
        "id", html.title(n).alias("title"), html.canonical(n).alias("canonical_url"), html.heading(n).alias("h1"), html.meta(n).alias("meta"), html.visible_text(n).alias("visible_text"),
        html.ld_bodies(n).alias("ld"), html.script_bodies(n).alias("scripts"), html.page_sightings(n).alias("dom"),
    )
    solved = read.withColumns({"ld_trees": html.ld_blocks("ld"), "trees": html.script_trees("scripts")})
    blobs, texts = html.script_channels(F.col("scripts"), F.col("trees"))
    told = solved.withColumns({"blobs": blobs, "script_texts": texts, "json_ld": F.transform("ld_trees", lambda t: t["data"])})
    json_blobs = F.transform(F.filter("blobs", lambda b: b["score"] > 0), lambda b: F.struct(b["source"].alias("source"), b["score"].alias("score"), b["data"].alias("data")))
    found = F.concat("dom", html.meta_sightings(F.col("meta")), html.tree_sightings(F.col("ld_trees"), "json_ld"), html.tree_sightings(F.col("blobs"), "blob"))
    evidence = F.struct("json_ld", "meta", "title", "canonical_url", "h1", json_blobs.alias("json_blobs"), "script_texts", "visible_text", media.in_order(found).alias("sightings"))
    return told.select("id", evidence.alias("evidence"))


def sightings(harvested: DataFrame) -> DataFrame:
    """page, seq, url, kind, origin, width, path_hint: a row for each of a page's media URLs."""
    # outer, as else a filter on the array's size would be inferred that makes the array a second time
    each = harvested.select(F.col("id").alias("page"), F.explode_outer("evidence.sightings").alias("m")).select("page", "m.*")
    # all that follows is grouped by page: rows are dealt by it once
    return media.merged_sightings(each.filter("url is not null").repartition("page"))


def _nodes(tree) -> list[dict]:
    if isinstance(tree, list):
        return [n for x in tree for n in _nodes(x)]
    if not isinstance(tree, dict):
        return []
    return _nodes(tree["@graph"]) if isinstance(tree.get("@graph"), list) else [tree]


def _types(node: dict) -> list[str]:
    kinds = node.get("@type")
    return [str(k) for k in kinds] if isinstance(kinds, list) else [str(kinds)] if kinds else []


def _listed(tree) -> list[dict]:
    return [{"types": _types(n), "name": n["name"] if isinstance(n.get("name"), str) else "", "data": jsontree.dumps(n)} for n in _nodes(tree)]


#: JSON-LD text to its nodes: lists and graphs unwrapped.
ld_nodes = over_values(jsontree._parsed(_listed), "array<struct<types:array<string>,name:string,data:string>>")


def anchored_ld(nodes: Column, identity: Column) -> Column:
    """Products that the page is about, and breadcrumbs; other nodes go."""
    product = lambda n: F.arrays_overlap(n["types"], F.array(*map(F.lit, PRODUCT_TYPES))) & text.matches_identity(n["name"], identity)
    return F.filter(nodes, lambda n: product(n) | F.array_contains(n["types"], "BreadcrumbList"))


def waterfall(parts: Column, budget: int, least_left: int) -> Column:
    """Ranked texts joined by line breaks: each takes what is left of the budget, until too little is or a text is null."""
    begin = F.struct(F.lit("").alias("out"), F.lit(budget).alias("left"), F.lit(True).alias("open"))

    def take(acc: Column, part: Column) -> Column:
        go = acc["open"] & part.isNotNull() & (acc["left"] >= least_left)
        glue = F.when(acc["left"] == budget, "").otherwise("\n")
        return F.struct(
            F.when(go, F.concat(acc["out"], glue, text.fit(part, acc["left"]))).otherwise(acc["out"]).alias("out"),
            F.when(go, acc["left"] - F.least(F.length(part), acc["left"])).otherwise(acc["left"]).cast("int").alias("left"),
            go.alias("open"),
        )

    return F.aggregate(parts, begin, take, lambda acc: acc["out"])


def distill(harvested: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """id, context, identity, images, videos, evidence: what a drafter reads of each page."""
    e, harvested = F.col("evidence"), materialized(harvested)
    identity = text.identity_tokens(e["h1"], F.try_element_at(e["meta"], F.lit("og:title")), e["title"])
    base = harvested.withColumn("identity", identity).withColumn("_flat", ld_nodes(F.concat(F.lit("["), F.array_join(e["json_ld"], ","), F.lit("]"))))
    blobs = F.slice(e["json_blobs"], 1, budgets.n_blobs)
    joined_blobs = F.array_join(F.transform(blobs, lambda b: b["data"]), ",")
    base = base.withColumn("_blobs", over_values(_blob_texts, "array<string>")(F.concat(F.lit("["), joined_blobs, F.lit("]"))))
    ld = anchored_ld(F.col("_flat"), F.col("identity"))
    base = base.withColumn("_ld", over_values(_ld_texts, "string")(F.concat(F.lit("["), F.array_join(F.transform(ld, lambda n: n["data"]), ","), F.lit("]"))))

    stems = harvested.select(F.col("id").alias("page"), media.heroes(e["meta"]).alias("stems"))
    shown = media.per_page(media.ranked(sightings(harvested), stems, budgets.images, budgets.videos)).withColumnRenamed("page", "id")
    base = base.join(shown, "id", "left")

    meta_lines = F.array_join(F.transform(F.map_entries(e["meta"]), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n")
    label = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    scripts = F.array_join(F.transform(F.slice(e["script_texts"], 1, budgets.n_scripts), lambda s: s["text"]), "\n")
    context = F.concat_ws(
        "\n\n",
        text.section("IDENTITY", F.concat_ws("\n", label("h1", e["h1"]), label("title", e["title"]), label("canonical", e["canonical_url"]))),
        text.section("JSON-LD", text.fit(F.col("_ld"), budgets.json_ld)),
        text.section("META", text.fit(meta_lines, budgets.meta)),
        text.section("PAGE STATE", waterfall(F.col("_blobs"), budgets.blobs, budgets.least_left)),
        text.section("SCRIPTS", text.fit(scripts, budgets.scripts)),
        text.section("VISIBLE TEXT", text.fit(e["visible_text"], budgets.visible)),
        text.section("MEDIA", F.col("rendered")),
    )
    empty = F.array().cast("array<string>")
    return base.select("id", context.alias("context"), "identity", F.coalesce("images", empty).alias("images"), F.coalesce("videos", empty).alias("videos"), "evidence")


def _blob_texts(data: str) -> list[str | None]:

    small = [jsontree.prune(t) for t in json.loads(data)]
    return [None if t is None else jsontree.dumps(jsontree.tabulate(t)) for t in small]


def _ld_texts(data: str) -> str:

    small = [jsontree.prune(t) for t in json.loads(data)]
    return "\n".join(jsontree.dumps(t) for t in small if t is not None)
