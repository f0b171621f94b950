"""Scores of products against ground truth: nine tolerant matchers, all Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import text, urls

# Fixed values.
FULL_TEXT = 0.7
CENT = 0.01
NAME_SHARE = 0.8
FIELDS = ["name", "price", "desc", "feat", "imgs", "video", "cat", "colors", "variants"]
PASS = 0.999


def _set(values: Column, each) -> Column:
    return F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), each))


def name_score(truth: Column, out: Column) -> Column:
    a, b = text.norm(truth), text.norm(out)
    return F.when(F.startswith(a, b) | F.startswith(b, a), 1.0).otherwise(0.0)


def close(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < CENT, F.lit(False))


def price_score(truth: Column, out: Column) -> Column:
    """Half for the price, a quarter each for currency and the price before."""
    before = (truth["compare_at_price"].isNull() & out["compare_at_price"].isNull()) | close(truth["compare_at_price"], out["compare_at_price"])
    same = F.coalesce(F.upper(truth["currency"]) == F.upper(out["currency"]), F.lit(False))
    return sum((F.when(ok, share).otherwise(0.0) for ok, share in ((same, 0.25), (before, 0.25))), F.when(close(truth["price"], out["price"]), 0.5).otherwise(0.0))


def set_text_score(a: Column, b: Column) -> Column:
    """Share of the smaller word set that is in the other one; from FULL_TEXT on it counts as all."""
    least = F.least(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / F.nullif(least, F.lit(0))
    score = F.when(share >= FULL_TEXT, 1.0).otherwise(F.bround(share, 2))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0).otherwise(score)


def text_score(truth: Column, out: Column) -> Column:
    return set_text_score(text.word_set(truth), text.word_set(out))


def feature_score(truth: Column, out: Column) -> Column:
    """Share of the expected features that some feature matches in full; 1 where none is expected."""
    truth_sets = F.transform(F.coalesce(truth, F.array().cast("array<string>")), text.word_set)
    out_sets = F.transform(F.coalesce(out, F.array().cast("array<string>")), text.word_set)
    hits = text.bound(out_sets, lambda sets: F.size(F.filter(truth_sets, lambda a: F.exists(sets, lambda b: set_text_score(a, b) == 1.0))))
    expected = F.coalesce(F.size(truth), F.lit(0))
    return F.when(expected <= 0, 1.0).otherwise(hits / F.nullif(expected, F.lit(0)))


def f1(truth: Column, out: Column) -> Column:
    """F1 of two sets, two decimals; without truth 1 for an empty set and a half for others."""
    both = F.size(F.array_intersect(truth, out))
    score = F.bround(2 * both / F.nullif(F.size(truth) + F.size(out), F.lit(0)), 2)
    return F.when(F.size(truth) == 0, F.when(F.size(out) == 0, 1.0).otherwise(0.5)).otherwise(score)


def image_score(truth: Column, out: Column) -> Column:
    return f1(_set(truth, urls.asset_key), _set(out, urls.asset_key))


def color_score(truth: Column, out: Column) -> Column:
    return f1(_set(truth, text.norm), _set(out, text.norm))


def video_score(truth: Column, out: Column) -> Column:
    plain = lambda u: urls.without_query(F.coalesce(u, F.lit("")))
    return F.when(plain(truth) == plain(out), 1.0).otherwise(0.0)


def category_score(truth: Column, out: Column) -> Column:
    """Half for a true beginning: the right area, not deep enough."""
    return F.when(truth == out, 1.0).when(F.startswith(truth, F.coalesce(out, F.lit(""))), 0.5).otherwise(0.0)


def _selection_key(variant: Column) -> Column:
    selections = F.coalesce(variant["selections"], F.array().cast(f"array<{schemas.SELECTION}>"))
    return F.array_sort(F.array_distinct(F.transform(selections, lambda s: F.struct(text.norm(s["name"]).alias("name"), text.norm(s["value"]).alias("value")))))


def listed_variant_score(truth: Column, out: Column) -> Column:
    """Half recall, a quarter precision, a quarter the quality of hits; of equal variants the last counts.

    Both sides' keys are made once a row; a truth variant's hit is looked up by its key's place.
    """
    rows = F.reverse(out)
    sides = F.struct(F.transform(rows, _selection_key).alias("keys"), F.transform(rows, lambda v: F.struct(v["price"].alias("price"), v["available"].alias("available"))).alias("rows"))

    def quality(t: Column, hit: Column) -> Column:
        wrong_price = t["price"].isNotNull() & (hit["price"].isNull() | (F.abs(t["price"] - hit["price"]) > CENT))
        missing = F.when(wrong_price, 0.25).otherwise(0.0) + F.when(t["available"].eqNullSafe(hit["available"]), 0.0).otherwise(0.25)
        return F.when(hit.isNotNull(), 1.0 - missing)

    def of(side: Column) -> Column:
        hit = lambda t: F.get(side["rows"], (F.array_position(side["keys"], _selection_key(t)) - 1).cast("int"))
        marks = F.transform(truth, lambda t: text.bound(hit(t), lambda h: quality(t, h)))
        some = F.filter(marks, lambda q: q.isNotNull())
        return F.struct(F.size(some).alias("n"), F.aggregate(some, F.lit(0.0), lambda s, q: s + q).alias("sum"))

    return text.bound(text.bound(sides, of), lambda found: _listed_score(truth, out, found))


def _listed_score(truth: Column, out: Column, found: Column) -> Column:
    hits = found["n"]
    mean = F.coalesce(found["sum"] / F.nullif(hits, F.lit(0)), F.lit(0.0))
    precision = F.coalesce(hits / F.nullif(F.size(out), F.lit(0)), F.lit(0.0))
    score = F.bround(hits / F.nullif(F.size(truth), F.lit(0)) * 0.5 + precision * 0.25 + mean * 0.25, 2)
    return F.when(F.size(truth) == 0, F.when(F.size(out) == 0, 1.0).otherwise(0.0)).otherwise(score)


def shaped_variant_score(count: Column, axes: Column, out: Column) -> Column:
    """Half for the number of variants, half for the axes that they have."""
    counted = F.when(F.size(out) > 0, F.least(F.size(out), count) / F.greatest(F.size(out), count)).otherwise(0.0)
    present = F.array_distinct(F.flatten(F.transform(out, lambda v: F.transform(v["selections"], lambda s: text.norm(s["name"])))))
    expected = _set(axes, text.norm)
    shared = F.size(F.array_intersect(present, expected)) / F.nullif(F.size(expected), F.lit(0))
    return F.bround(0.5 * counted + 0.5 * shared, 2)


def variant_score(truth: Column, out: Column) -> Column:
    """truth is JSON text: a list of variants, or their number and axes."""
    out = F.coalesce(out, F.array().cast(f"array<{schemas.VARIANT}>"))
    listed = F.coalesce(F.from_json(truth, f"array<{schemas.VARIANT}>"), F.array().cast(f"array<{schemas.VARIANT}>"))
    shape = F.from_json(truth, "count int, axes array<string>")
    is_shape = F.startswith(F.ltrim(F.coalesce(truth, F.lit("[]"))), F.lit("{"))
    return F.when(is_shape, shaped_variant_score(shape["count"], shape["axes"], out)).otherwise(listed_variant_score(listed, out))


def field_scores(truth: DataFrame, out: DataFrame) -> DataFrame:
    """id and the nine scores; a product that isn't there scores 0 in all."""
    pairs = truth.alias("t").join(out.alias("o"), F.col("t.id") == F.col("o.id"), "left")
    t, o = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"o.{c}"))
    scores = {
        "name": name_score(t("name"), o("name")), "price": price_score(t("price"), o("price")), "desc": text_score(t("description"), o("description")),
        "feat": feature_score(t("key_features"), o("key_features")), "imgs": image_score(t("image_urls"), o("image_urls")), "video": video_score(t("video_url"), o("video_url")),
        "cat": category_score(t("category.name"), o("category.name")), "colors": color_score(t("colors"), o("colors")), "variants": variant_score(t("variants"), o("variants")),
    }
    return pairs.select(t("id").alias("id"), *(F.when(o("id").isNull(), 0.0).otherwise(s).alias(f) for f, s in scores.items()))


def page_means(scores: DataFrame) -> DataFrame:
    """scores, each page's mean, and which fields aren't full."""
    mean = sum((F.col(f) for f in FIELDS[1:]), F.col(FIELDS[0])) / len(FIELDS)
    return scores.withColumn("mean", mean).withColumn("misses", F.array_compact(F.array(*(F.when(F.col(f) < 1, F.lit(f)) for f in FIELDS))))


def scoreboard(scores: DataFrame) -> DataFrame:
    """One row: each field's mean over pages, their mean, and whether that passes."""
    means = scores.agg(*(F.avg(f).alias(f) for f in FIELDS))
    overall = sum((F.col(f) for f in FIELDS[1:]), F.col(FIELDS[0])) / len(FIELDS)
    return means.withColumn("overall", overall).withColumn("passes", F.col("overall") >= PASS)


def category_bench(expected: DataFrame, out: DataFrame, graded: DataFrame) -> DataFrame:
    """id, predicted, accepted, correct, graded for each expected page. expected: id, accepted; out: id, category; graded: id."""
    marks = graded.select("id").distinct().withColumn("graded", F.lit(True))
    joined = expected.join(out.select("id", F.col("category").alias("predicted")), "id", "left").join(marks, "id", "left")
    return joined.select("id", "predicted", "accepted", F.coalesce(F.array_contains("accepted", F.col("predicted")), F.lit(False)).alias("correct"), F.coalesce("graded", F.lit(False)).alias("graded"))


def unexpected(graded: DataFrame, expected: DataFrame) -> DataFrame:
    """Graded ids without an expectation: there must be none."""
    return graded.select("id").join(expected.select("id"), "id", "left_anti")


def accuracy(bench: DataFrame) -> DataFrame:
    share = lambda good, n: F.coalesce(good / F.nullif(n, F.lit(0)), F.lit(0.0))
    good, graded = F.count_if("correct"), F.count_if("graded")
    return bench.agg(
        F.count(F.lit(1)).alias("n"), good.alias("n_correct"), share(good, F.count(F.lit(1))).alias("accuracy"), graded.alias("n_graded"),
        share(F.count_if(F.col("graded") & F.col("correct")), graded).alias("graded_accuracy"),
    )


def wrong_pages(bench: DataFrame) -> DataFrame:
    return bench.filter(~F.col("correct")).select("id", "predicted", F.array_join("accepted", " | ").alias("accepted"))


def unreachable(truth: Column, context: Column, asset_keys: Column) -> Column:
    """Labels of true facts that a page's context and media don't show. truth: a struct of the truth's columns."""
    low = F.lower(context)
    has = lambda value: F.contains(low, F.lower(value))
    label = lambda kind, value: F.concat(F.lit(f"{kind} "), value)
    words = F.filter(text.alnum_words(truth["name"]), lambda w: F.length(w) > 2)
    price = truth["price"]

    def longest(feature: Column) -> Column:
        found = F.regexp_extract_all(F.lower(feature), F.lit("[a-z]{4,}"), F.lit(0))
        return F.get(found, F.array_min(F.transform(found, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"))))["i"])

    listed = F.coalesce(F.from_json(truth["variants"], f"array<{schemas.VARIANT}>"), F.array().cast(f"array<{schemas.VARIANT}>"))
    values = F.flatten(F.transform(listed, lambda v: F.transform(v["selections"], lambda s: s["value"])))
    single = F.array(
        F.when(F.size(F.filter(words, lambda w: F.contains(low, w))) < NAME_SHARE * F.size(words), "name"), F.when(~has(truth["brand"]), "brand"),
        F.when(~text.on_page(price["price"], context, thousands=False), label("price", price["price"].cast("string"))),
        F.when((price["compare_at_price"] != 0) & ~text.on_page(price["compare_at_price"], context, thousands=False), label("compare_at", price["compare_at_price"].cast("string"))),
        F.when(F.coalesce(truth["video_url"], F.lit("")).rlike(".") & ~F.array_contains(asset_keys, urls.asset_key(truth["video_url"])), "video"),
    )
    lists = [
        F.transform(F.transform(truth["key_features"], longest), lambda w: F.when(~F.contains(low, w), label("feature word", w))),
        F.transform(truth["colors"], lambda c: F.when(~has(c), label("color", c))),
        F.transform(values, lambda v: F.when(~has(v), label("variant value", v))),
        F.transform(F.transform(truth["image_urls"], urls.asset_key), lambda k: F.when(~F.array_contains(asset_keys, k), label("image", k))),
    ]
    return F.array_compact(F.concat(single, *(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def least_budgets(facts: DataFrame, channels: DataFrame, scales: Sequence[float]) -> DataFrame:
    """id, fact, scale: for each fact the least scale of the budgets at which a channel, cut to its budget, shows it; null if none does.

    facts: id, fact (what to look for, whatever its case); channels: id, text, budget. All scales are judged by the one place where the fact
    stands first in the uncut text, so that a page is harvested and read once, not once for each budget.
    """
    ends = F.expr("locate(lower(fact), lower(text))")
    end = F.when(ends > 0, ends + F.length("fact") - 1)
    steps = F.array(*(F.lit(float(x)) for x in sorted(scales)))
    least = F.get(F.filter(steps, lambda x: F.floor(x * F.col("budget")) >= end), F.lit(0))
    seen = facts.join(channels, "id", "left").groupBy("id", "fact").agg(F.min(least).alias("scale"))
    return seen.select("id", "fact", "scale")
