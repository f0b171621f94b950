"""The catalog: summaries, details, search, lookup, sale figures, and what a product page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SHOWN_FEATURES = 8
#: Code, decimals, symbol.
CURRENCIES = [
    ("USD", 2, "$"), ("EUR", 2, "€"), ("GBP", 2, "£"), ("JPY", 0, "¥"), ("CAD", 2, "CA$"), ("AUD", 2, "A$"), ("NZD", 2, "NZ$"), ("MXN", 2, "MX$"), ("BRL", 2, "R$"), ("INR", 2, "₹"),
    ("KRW", 0, "₩"), ("CNY", 2, "CN¥"), ("ILS", 2, "₪"), ("VND", 0, "₫"), ("CLP", 0, "CLP "), ("SEK", 2, "SEK "), ("NOK", 2, "NOK "), ("DKK", 2, "DKK "), ("CHF", 2, "CHF "), ("KWD", 3, "KWD "),
]


def currencies(spark: SparkSession) -> DataFrame:
    """code, digits, symbol: the dimension that prices are shown by."""
    return spark.createDataFrame(CURRENCIES, "code string, digits int, symbol string")


def summaries(products: DataFrame, graded: DataFrame | None = None) -> DataFrame:
    """id, name, brand, price, image_url, hover_image_url, category, source; graded has the ids of pages of the assignment."""
    marked = products.withColumn("_graded", F.lit(False)) if graded is None else products.join(graded.select("id").distinct().withColumn("_graded", F.lit(True)), "id", "left")
    return marked.select(
        "id", "name", "brand", "price", F.get("image_urls", F.lit(0)).alias("image_url"), F.get("image_urls", F.lit(1)).alias("hover_image_url"),
        F.col("category.name").alias("category"), F.when(F.coalesce("_graded", F.lit(False)), "assignment").otherwise("unseen").alias("source"),
    )


def search(catalog: DataFrame, query: str = "", source: str | None = None) -> DataFrame:
    """Rows whose name and brand have the query in them, whatever its case; a blank query and no source keep all."""
    kept = catalog if source is None else catalog.filter(F.col("source") == source)
    wanted = query.strip().lower()
    return kept.filter(F.contains(F.lower(F.concat_ws(" ", "name", "brand")), F.lit(wanted))) if wanted else kept


class NotFound(KeyError):
    pass


def lookup(catalog: DataFrame, product_id: str) -> DataFrame:
    """The row of an id; the filter reaches the scan."""
    return catalog.filter(F.col("id") == product_id)


def detail(catalog: DataFrame, product_id: str) -> dict:
    """The row of an id as a dict, NotFound if there is none: for a server's handler."""
    rows = lookup(catalog, product_id).limit(1).collect()
    if not rows:
        raise NotFound(product_id)
    return rows[0].asDict(recursive=True)


def source_counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("source") == "assignment").alias("n_assignment"), F.count_if(F.col("source") == "unseen").alias("n_unseen"))


def on_sale(price: Column, compare_at: Column) -> Column:
    return F.coalesce(compare_at > price, F.lit(False))


def percent_off(price: Column, compare_at: Column) -> Column:
    """Whole per cent, halves up; null where nothing is off."""
    return F.when(on_sale(price, compare_at), F.floor((1 - price / compare_at) * 100 + 0.5))


def _with_digits(amount: Column, digits: Column) -> Column:
    """An amount rounded (halves up) and grouped by thousands."""
    forms = [F.when(digits == d, F.format_number(F.round(amount, d), d)) for d in (0, 1, 2, 3)]
    return F.coalesce(*forms, F.format_number(F.round(amount, 2), 2))


def with_price_label(rows: DataFrame, dimension: DataFrame, amount: Column, currency: Column, out_col: str = "price_label") -> DataFrame:
    """rows with a column of the price as shown: symbol and amount by the currency's decimals; a code that the dimension lacks follows the
    plain amount, and so does none. A null amount has no label. dimension: code, digits, symbol, of few rows.
    """
    known = dimension.select(F.col("code").alias("_code"), F.col("digits").alias("_digits"), F.col("symbol").alias("_symbol"))
    code = F.upper(F.trim(currency))
    joined = rows.withColumn("_amount", amount).withColumn("_own", code).join(known, F.col("_own") == F.col("_code"), "left")
    sign = F.when(F.col("_amount") < 0, "-").otherwise("")
    shown = F.concat(sign, F.col("_symbol"), _with_digits(F.abs("_amount"), F.col("_digits")))
    plain = F.concat_ws(" ", F.format_number(F.round("_amount", 2), 2), F.nullif("_own", F.lit("")))
    label = F.when(F.col("_amount").isNotNull(), F.coalesce(shown, plain))
    return joined.withColumn(out_col, label).drop("_amount", "_own", "_code", "_digits", "_symbol")


def crumbs(category: Column) -> Column:
    return F.split(category, " > ")


def page_view(products: DataFrame) -> DataFrame:
    """id, leaf, crumbs, colors as text, the features shown at first, slides: images and then the video, first letter of the brand."""
    path = crumbs(F.col("category.name"))
    slides = F.concat(F.coalesce("image_urls", F.array()), F.array_compact(F.array("video_url")))
    return products.select(
        "id", F.element_at(path, -1).alias("leaf"), path.alias("crumbs"), F.array_join("colors", ", ").alias("colors_text"),
        F.slice("key_features", 1, SHOWN_FEATURES).alias("features"), slides.alias("slides"), F.left("brand", F.lit(1)).alias("initial"),
    )


def alive(slides: Column, dead: Column) -> Column:
    """Slides but those whose places are dead."""
    return F.filter(slides, lambda s, i: ~F.array_contains(dead, i))


def current_slide(slides: Column, dead: Column, wanted: Column) -> Column:
    """The slide at a place; where it is dead or there is none, the first that is alive."""
    at = F.when(~F.array_contains(dead, wanted) & (wanted >= 0), F.get(slides, wanted))
    return F.coalesce(at, F.get(alive(slides, dead), F.lit(0)))


def card_image(image: Column, hover: Column, brand: Column, name: Column, dead: Column | None = None) -> Column:
    """src and initial: the first of the two images that isn't among the dead ones; where none is left, the first letter of the brand, or of the name, stands for it."""
    given = F.array_compact(F.array(image, hover))
    src = F.get(given if dead is None else F.array_except(given, F.coalesce(dead, F.array().cast("array<string>"))), F.lit(0))
    return F.struct(src.alias("src"), F.when(src.isNull(), F.left(F.coalesce(brand, name, F.lit("?")), F.lit(1))).alias("initial"))
