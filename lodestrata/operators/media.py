"""Media of a page: renditions of one asset meet, groups are ranked, filtered and capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import html, text, urls

# Fixed values.
MOST_IMAGES, MOST_VIDEOS = 40, 5
ENOUGH_CLEAN = ENOUGH_BOOSTED = 3
MOST_SPREAD = 3


def paths_of(hints: Column) -> Column:
    return F.filter(F.split(F.lower(hints), r"\s+"), lambda p: p != "")


def only_related(hints: Column) -> Column:
    """Whether there are key paths and all lead through related items, none through a selected product."""
    paths = paths_of(hints)
    return (F.size(paths) > 0) & F.forall(paths, lambda p: p.rlike(text.RELATED_PATH) & ~p.rlike(text.SELECTED_PATH))


def tag(origin: Column, hints: Column) -> Column:
    """Where a candidate comes from, in words."""
    return (
        F.when(F.lower(hints).rlike(text.SELECTED_PATH), " [selected product]").when(only_related(hints), " [related items rail]")
        .when(origin == "meta", " [page hero]").when(origin.isin("blob", "json_ld"), " [product data]").otherwise("")
    )


def heroes(meta: Column) -> Column:
    return urls.hero_stems(*(F.try_element_at(meta, F.lit(k)) for k in html.HERO_KEYS))


def in_order(found: Column) -> Column:
    """Sightings with absolute URLs and without noise, each sized image followed by its query-free twin; seq is their order."""
    own = F.filter(F.transform(found, lambda s: s.withField("url", urls.absolute(s["url"]))), lambda s: s["url"].isNotNull() & ~urls.is_noise(s["url"]))

    def with_twin(s: Column) -> Column:
        twin = F.when(s["kind"] == "image", urls.sized_twin(s["url"]))
        made = F.struct(twin.alias("url"), s["kind"].alias("kind"), s["origin"].alias("origin"), F.lit(None).cast("int").alias("width"), F.lit("").alias("path_hint"))
        return F.filter(F.array(s, made), lambda x: x["url"].isNotNull())

    fields = ("url", "kind", "origin", "width", "path_hint")
    return F.transform(F.flatten(F.transform(own, with_twin)), lambda s, i: F.struct(i.cast("int").alias("seq"), *(s[f].alias(f) for f in fields)))


def _joined_hints(seen: Column) -> Column:
    """Key paths in their order, without those that stand in what is joined so far."""
    take = lambda out, s: F.when(F.contains(out, s["path_hint"]), out).otherwise(F.trim(F.concat(out, F.lit(" "), s["path_hint"])))
    return F.aggregate(F.filter(seen, lambda s: s["path_hint"] != ""), F.lit(""), take)


def merged_sightings(sightings: DataFrame) -> DataFrame:
    """One row for each page and URL: first kind and origin, greatest width, all key paths in order. sightings: page, seq, url, kind, origin, width, path_hint.

    A twin (see in_order) of a URL that is seen anyway adds nothing, as it has neither width nor path, so twins need no second look.
    """
    seen = F.array_sort(F.collect_list(F.struct("seq", "kind", "origin", "width", F.coalesce("path_hint", F.lit("")).alias("path_hint"))))
    wide = F.max(F.when(F.col("width") > 0, F.col("width")))
    found = sightings.groupBy("page", "url").agg(seen.alias("seen"), wide.alias("wide"))
    first = F.get("seen", F.lit(0))
    return found.select("page", "url", first["kind"].alias("kind"), first["origin"].alias("origin"), F.coalesce("wide", first["width"]).alias("width"), _joined_hints(F.col("seen")).alias("path_hint"), first["seq"].alias("seq"))


def ranked(candidates: DataFrame, stems: DataFrame | None = None, images: int = MOST_IMAGES, videos: int = MOST_VIDEOS) -> DataFrame:
    """The best rendition of each asset, with its rank among the page's kind; filtered and capped at so many images and videos.

    candidates: page, seq, url, kind, origin, width, path_hint; stems: page, stems. Groups that only related rails show
    go where enough others are left; where enough are boosted by a selected path, unboosted structured ones go.
    Adds asset, demoted, boosted, stem_hits, spread, rank (from 0, in the order of relevance, ties by seq).
    All is grouped by page, so candidates that are dealt by it are not shuffled again.
    """
    base = candidates.withColumn("asset", urls.asset_key(F.col("url"))).withColumn("quality", urls.quality(F.col("url"), F.col("origin"), F.col("width")))
    in_order = F.array_sort(F.collect_list(F.struct("seq", "path_hint")))
    hints = F.array_join(F.transform(in_order, lambda x: F.coalesce(x["path_hint"], F.lit(""))), " ")
    best = F.max_by(F.struct("url", "origin", "width", "path_hint", "quality"), F.struct("quality", (-F.col("seq")).alias("first")))
    groups = base.groupBy("page", "kind", "asset").agg(
        hints.alias("hints"), F.least(F.size(F.collect_set("origin")), F.lit(MOST_SPREAD)).alias("spread"), F.bool_and(F.col("origin").isin("blob", "json_ld")).alias("structured"),
        best.alias("best"), F.min("seq").alias("seq"),
    )
    groups = groups.withColumn("demoted", only_related(F.col("hints"))).withColumn("boosted", F.lower("hints").rlike(text.SELECTED_PATH))
    if stems is None:
        groups = groups.withColumn("stem_hits", F.lit(0))
    else:
        groups = groups.join(stems, "page", "left").withColumn("stem_hits", F.coalesce(F.size(F.filter("stems", lambda s: F.contains(F.col("asset"), s))), F.lit(0))).drop("stems")
    per_page = Window.partitionBy("page")
    image = F.col("kind") == "image"
    clean, boosted = F.count_if(image & ~F.col("demoted")).over(per_page), F.count_if(image & F.col("boosted")).over(per_page)
    counted = groups.withColumn("_clean", clean).withColumn("_boosted", boosted)
    lost = image & ((F.col("demoted") & (F.col("_clean") >= ENOUGH_CLEAN)) | ((F.col("_boosted") >= ENOUGH_BOOSTED) & ~F.col("boosted") & F.col("structured")))
    relevance = F.struct((~F.col("demoted")).alias("a"), F.col("boosted").alias("b"), F.col("stem_hits").alias("c"), F.col("spread").alias("d"), F.col("best.quality").alias("e"))
    order = Window.partitionBy("page", "kind").orderBy(relevance.desc(), F.col("seq"))
    kept = counted.filter(~lost).withColumn("rank", F.row_number().over(order) - 1)
    kept = kept.filter(((F.col("kind") == "image") & (F.col("rank") < images)) | ((F.col("kind") == "video") & (F.col("rank") < videos)))
    return kept.select("page", "kind", "asset", "rank", "best.url", "best.origin", "best.width", "best.path_hint", "demoted", "boosted", "stem_hits", "spread", "seq")


def per_page(kept: DataFrame) -> DataFrame:
    """page, images array, videos array, rendered string: URLs by index, and their numbered listing, images first."""
    label = F.when(F.col("kind") == "image", "IMG_").otherwise("VID_")
    line = F.concat(label, F.col("rank").cast("string"), F.lit(" "), F.col("url"), tag(F.col("origin"), F.col("path_hint")))
    row = F.struct("kind", "rank", F.col("url").alias("url"), line.alias("line"))
    packed = kept.groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    of = lambda kind: F.transform(F.filter("rows", lambda r: r["kind"] == kind), lambda r: r["url"])
    return packed.select("page", of("image").alias("images"), of("video").alias("videos"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("rendered"))
