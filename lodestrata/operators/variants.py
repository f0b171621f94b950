"""Variants of a product against a user's selections: columns over array<variant> and map<axis, value>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DENSE = 0.6


def matches(variant: Column, chosen: Column) -> Column:
    """Whether no selection of the variant contradicts what is chosen; axes that aren't chosen don't matter."""
    return F.forall(variant["selections"], lambda s: ~F.map_contains_key(chosen, s["name"]) | (F.try_element_at(chosen, s["name"]) == s["value"]))


def fully_chosen(variant: Column, chosen: Column) -> Column:
    return F.forall(variant["selections"], lambda s: F.map_contains_key(chosen, s["name"]))


def resolve(variants: Column, chosen: Column) -> Column:
    """The most specific variant that matches with all its axes chosen; the first of several; null if none."""
    fit = F.filter(variants, lambda v: matches(v, chosen) & fully_chosen(v, chosen))
    placed = F.transform(fit, lambda v, i: F.struct((-F.size(v["selections"])).alias("n"), i.alias("i")))
    return F.get(fit, F.array_min(placed)["i"])


def images(variants: Column, chosen: Column) -> Column:
    """Distinct images of matching variants, without template URLs; none while nothing is chosen."""
    fit = F.flatten(F.transform(F.filter(variants, lambda v: matches(v, chosen)), lambda v: F.coalesce(v["image_urls"], F.array().cast("array<string>"))))
    real = F.array_distinct(F.filter(fit, lambda u: ~F.contains(u, F.lit("{"))))
    return F.when(F.size(F.map_keys(chosen)) == 0, F.array().cast("array<string>")).otherwise(real)


def combinations(options: Column) -> Column:
    """Product of the axes' numbers of values; an axis without values counts once."""
    return F.aggregate(options, F.lit(1).cast("long"), lambda n, o: n * F.greatest(F.size(o["values"]), F.lit(1)))


def dense(variants: Column, options: Column) -> Column:
    """Whether so many of the combinations are variants that a missing one means: not offered."""
    some = (F.size(variants) > 0) & (F.size(options) > 0)
    return F.when(some, F.size(variants) / combinations(options) >= DENSE).otherwise(False)


def with_choice(chosen: Column, axis: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(chosen, lambda k, _: k != axis), F.create_map(axis, value))


def disabled(variants: Column, options: Column, chosen: Column, axis: Column, value: Column) -> Column:
    """Whether choosing a value would leave no variant, where the variants are dense enough to say so."""
    then = with_choice(chosen, axis, value)
    return dense(variants, options) & ~F.exists(variants, lambda v: matches(v, then))


def buttons(products: DataFrame, chosen: Column) -> DataFrame:
    """id, axis, value, selected, disabled: a row for each value of each option. A selected value's button is never disabled."""
    each = products.select("id", "variants", "options", chosen.alias("chosen"), F.explode("options").alias("option"))
    each = each.select("id", "variants", "options", "chosen", F.col("option.name").alias("axis"), F.explode("option.values").alias("value"))
    selected = F.coalesce(F.try_element_at("chosen", F.col("axis")) == F.col("value"), F.lit(False))
    hidden = disabled(F.col("variants"), F.col("options"), F.col("chosen"), F.col("axis"), F.col("value"))
    return each.select("id", "axis", "value", selected.alias("selected"), (~selected & hidden).alias("disabled"))


def toggled(chosen: Column, axis: Column, value: Column) -> Column:
    """What is chosen after a click: the value, or nothing on the axis if it was chosen before."""
    again = F.coalesce(F.try_element_at(chosen, axis) == value, F.lit(False))
    return F.when(again, F.map_filter(chosen, lambda k, _: k != axis)).otherwise(with_choice(chosen, axis, value))


def jump_to(variants: Column, chosen: Column, gallery: Column) -> Column:
    """The first image of the matching variants that the gallery has."""
    return F.get(F.array_intersect(images(variants, chosen), gallery), F.lit(0))


def shown(variant: Column, price: Column) -> Column:
    """The price that counts while a variant is resolved."""
    return F.coalesce(variant["price"], price)
