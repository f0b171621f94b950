"""Drafts: a rule-based drafter, provenance checks, a retry ladder with a dead-letter table, and assembly.

A drafter maps contexts to drafts. The one here is deterministic; a client of a model has the same shape, see Drafter.
"""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import text, urls
from lodestrata.functions.arrow import over_values
from lodestrata.functions.materialize import materialized
from lodestrata.operators import taxonomy

ERROR_CHARS = 2000
BASELINE_HINT = 200


class Drafter(Protocol):
    """contexts: id, context, images, videos, evidence, repair (text of the last attempt's problems, or null). Adds draft, of schemas.DRAFT."""

    def __call__(self, contexts: DataFrame) -> DataFrame: ...


def _product(blocks: list) -> dict:
    """The first product among JSON-LD blocks: lists and graphs are searched, a node counts by its type."""
    todo = list(blocks)
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo = node + todo
        elif isinstance(node, dict):
            kinds = node.get("@type")
            if set(kinds if isinstance(kinds, list) else [kinds]) & {"Product", "ProductGroup"}:
                return node
            if isinstance(node.get("@graph"), list):
                todo = node["@graph"] + todo
    return {}


def _number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def facts(blocks: str) -> dict:
    """What structured data says of a product: the shape of FACTS. Empty values are null."""
    node = _product(json.loads(blocks))
    offers = node.get("offers") or {}
    offers = (offers[0] if offers else {}) if isinstance(offers, list) else offers
    offers = offers if isinstance(offers, dict) else {}
    brand = node.get("brand") or {}
    images = node.get("images") or node.get("image") or []
    images = [images] if isinstance(images, (str, dict)) else images
    notes = node.get("positiveNotes") or []
    notes = list(notes.values()) if isinstance(notes, dict) else notes if isinstance(notes, list) else []
    color = node.get("color")
    return {
        "name": str(node.get("name") or "") or None,
        "description": str(node.get("description") or "") or None,
        "brand": str((brand.get("name") if isinstance(brand, dict) else brand) or "") or None,
        "price": _number(offers.get("price")),
        "currency": str(offers.get("priceCurrency") or ""),
        "image_urls": [str(x.get("url", "")) if isinstance(x, dict) else str(x) for x in images if x],
        "key_features": [str(x) for x in notes],
        "colors": [color] if isinstance(color, str) else [],
    }


FACTS = "struct<name:string,description:string,brand:string,price:double,currency:string,image_urls:array<string>,key_features:array<string>,colors:array<string>>"
ld_facts = over_values(facts, FACTS)


def evidence_facts(evidence: Column) -> Column:
    return ld_facts(F.concat(F.lit("["), F.array_join(evidence["json_ld"], ","), F.lit("]")))


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def baseline(harvested: DataFrame, paths: DataFrame) -> DataFrame:
    """id and a product's columns, from structured data and meta tags alone; the category is the best lexical match."""
    e = F.col("evidence")
    m = lambda key: F.try_element_at(e["meta"], F.lit(key))
    f = F.col("f")
    base = harvested.withColumn("f", evidence_facts(e)).select(
        "id", filled(f["name"], m("og:title"), e["title"]).alias("name"), filled(f["description"], m("og:description"), m("description")).alias("description"),
        F.coalesce(f["brand"], F.lit("")).alias("brand"), F.struct(f["price"].alias("price"), f["currency"].alias("currency"), F.lit(None).cast("double").alias("compare_at_price")).alias("price"),
        F.when(F.size(f["image_urls"]) > 0, f["image_urls"]).otherwise(F.array_compact(F.array(F.nullif(m("og:image"), F.lit(""))))).alias("image_urls"),
        f["key_features"].alias("key_features"), f["colors"].alias("colors"),
    )
    hint = F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("brand", F.lit("")), F.left("description", F.lit(BASELINE_HINT)))
    found = taxonomy.lexical_topk(base.select(F.col("id").alias("q"), hint.alias("text")), paths, 1).select(F.col("q").alias("id"), "path")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    joined = base.join(found, "id", "left")
    return joined.select(
        "id", "name", "price", "description", "key_features", "image_urls", F.lit(None).cast("string").alias("video_url"),
        F.struct(F.coalesce("path", F.lit("")).alias("name")).alias("category"), "brand", "colors", none(schemas.OPTION).alias("options"), none(schemas.VARIANT).alias("variants"),
    )


class RuleDrafter:
    """Reads structured data, then meta tags and headings. With an error to repair it drops what was complained of."""

    def __call__(self, contexts: DataFrame) -> DataFrame:
        e, f = F.col("evidence"), F.col("_f")
        m = lambda key: F.try_element_at(e["meta"], F.lit(key))
        wanted = F.transform(f["image_urls"], urls.asset_key)
        ids = F.filter(F.transform("images", lambda u, i: F.when(F.array_contains(wanted, urls.asset_key(u)), i)), lambda i: i.isNotNull())
        first = F.when(F.size("images") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        price = F.when((f["price"] != 0) & ~F.coalesce(F.contains("repair", F.lit("price")), F.lit(False)), f["price"])
        names = filled(f["name"], m("og:title"), e["h1"], e["title"])
        fields = {
            "name": names, "price": price, "currency": f["currency"], "compare_at_price": F.lit(None), "description": filled(f["description"], m("og:description"), m("description")),
            "key_features": f["key_features"], "image_ids": F.when(F.size(ids) > 0, ids).otherwise(first), "video_id": F.when(F.size("videos") > 0, 0),
            "candidate_categories": F.array(names), "brand": filled(f["brand"], m("og:site_name")), "colors": f["colors"], "options": F.array(), "variants": F.array(),
        }
        made = F.struct(*(v.alias(k) for k, v in fields.items())).cast(schemas.DRAFT)
        return contexts.withColumn("_f", evidence_facts(e)).withColumn("draft", made).drop("_f")


def problems(draft: Column, context: Column, n_images: Column) -> Column:
    """Messages for what the page doesn't bear out: prices that it doesn't show, images that don't exist or weren't chosen."""
    price = lambda name, value: F.when(value.isNotNull() & ~text.on_page(value, context), F.concat(F.lit(f"{name} "), text.general_format(value), F.lit(" is not on the page")))
    ids = F.coalesce(draft["image_ids"], F.array().cast("array<int>"))
    return F.array_compact(
        F.array(
            price("price", draft["price"]), price("compare_at_price", draft["compare_at_price"]),
            F.when(F.exists(ids, lambda i: (i < 0) | (i >= n_images)), F.concat(F.lit("image ids must be 0 to "), (n_images - 1).cast("string"))),
            F.when((F.size(ids) == 0) & (n_images > 0), F.lit("no images were chosen though there are candidates")),
        )
    )


def drafted(contexts: DataFrame, ladder: list[Drafter]) -> tuple[DataFrame, DataFrame]:
    """Good rows (with draft and attempt) and dead letters (with error): each rung of the ladder gets what the one before left, with its problems to repair.

    Each rung is written down before its rows are told apart, so no draft is made twice.
    """
    names = [c for c in contexts.columns if c != "repair"]
    left, good = contexts.withColumn("repair", F.lit(None).cast("string")), None
    for attempt, drafter in enumerate(ladder, 1):
        made = materialized(drafter(left))
        tried = materialized(made.withColumn("_problems", problems(F.col("draft"), F.col("context"), F.size("images"))))
        fine = tried.filter(F.size("_problems") == 0).select(*names, "draft", F.lit(attempt).alias("attempt"))
        good = fine if good is None else good.unionByName(fine)
        left = tried.filter(F.size("_problems") > 0).select(*names, F.left(F.array_join("_problems", "; "), F.lit(ERROR_CHARS)).alias("repair"))
    return good, left.select(*names, F.col("repair").alias("error"))


def at_indices(values: Column, ids: Column) -> Column:
    """The values at some places, those out of range left out."""
    found = F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.when(i >= 0, F.get(values, i)))
    return F.filter(found, lambda x: x.isNotNull())


def assembled(good: DataFrame, categories: DataFrame) -> DataFrame:
    """id and a product's columns: indices become URLs, variants without a selection go. categories: q, category."""
    d = F.col("draft")

    def variant(v: Column) -> Column:
        return F.struct(v["selections"].alias("selections"), v["sku"].alias("sku"), v["price"].alias("price"), v["available"].alias("available"), at_indices(F.col("images"), v["image_ids"]).alias("image_urls"))

    variants = F.transform(F.filter(d["variants"], lambda v: F.size(v["selections"]) > 0), variant)
    joined = good.join(categories.withColumnRenamed("q", "id"), "id")
    return joined.select(
        "id", d["name"].alias("name"), F.struct(F.coalesce(d["price"], F.lit(0.0)).alias("price"), d["currency"].alias("currency"), d["compare_at_price"].alias("compare_at_price")).alias("price"),
        d["description"].alias("description"), d["key_features"].alias("key_features"), at_indices(F.col("images"), d["image_ids"]).alias("image_urls"),
        F.when(d["video_id"] >= 0, F.get("videos", d["video_id"])).alias("video_url"), F.struct(F.col("category").alias("name")).alias("category"), d["brand"].alias("brand"),
        d["colors"].alias("colors"), d["options"].alias("options"), variants.alias("variants"),
    )


def extract_batch(contexts: DataFrame, paths: DataFrame, ladder: list[Drafter] | None = None, vector: taxonomy.Ranker | None = None) -> tuple[DataFrame, DataFrame]:
    """Products of distilled pages (drafted, checked, classified and assembled), and the dead letters: id and error of the pages
    that no rung mended or that have no category. A page that fails breaks no other. With vector, categories come from both retrievals.
    """
    good, dead = drafted(contexts, ladder or [RuleDrafter(), RuleDrafter()])
    d = F.col("draft")
    asked = taxonomy.query_text(F.array_join(d["candidate_categories"], " "), d["name"], d["brand"], d["description"], text.breadcrumb_hint(F.col("context")))
    categories = materialized(taxonomy.resolved(good.select(F.col("id").alias("q"), asked.alias("text")), paths, vector=vector))
    unplaced = good.join(categories.select(F.col("q").alias("id")), "id", "left_anti").select("id", F.lit("no category matches").alias("error"))
    return assembled(good, categories), dead.select("id", "error").unionByName(unplaced)


def extract_products(contexts: DataFrame, paths: DataFrame, ladder: list[Drafter] | None = None, vector: taxonomy.Ranker | None = None) -> DataFrame:
    """The products of extract_batch; pages that fail any step have no row."""
    return extract_batch(contexts, paths, ladder, vector)[0]


def tally(good: DataFrame, dead: DataFrame) -> DataFrame:
    """ok, n, first_id: how a batch went, and the least id of either kind."""
    rows = good.select("id", F.lit(True).alias("ok")).unionByName(dead.select("id", F.lit(False).alias("ok")))
    return rows.groupBy("ok").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
