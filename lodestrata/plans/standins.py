"""Stand-ins for product pages, products, media and variants, made of the test tables, as the pages there have none.

Everything is a plain function of the tables' rows, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.sources.pages import table

HOST = "https://img.example.com"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts dealt to as many tasks as a shuffle has: the file is small for what is made of a row, so its splits are too few.

    The number is named, as else adaptive execution would take the small rows together again.
    """
    return table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def _products(part: DataFrame) -> DataFrame:
    key, n = F.col("p_partkey"), F.col("p_partkey") % 4
    price = F.col("p_retailprice")
    urls = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= n), lambda i: F.concat(F.lit(f"{HOST}/p/"), key.cast("string"), F.lit("/view"), i.cast("string"), F.lit(".jpg?w=640")))
    return part.select(
        F.concat(F.lit("p"), key.cast("string")).alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"),
        F.struct(price.alias("price"), F.when(key % 7 == 0, "JPY").otherwise("USD").alias("currency"), F.when(key % 5 == 0, price * 1.25).alias("compare_at_price")).alias("price"),
        F.concat_ws(" ", F.lit("A"), "p_name", F.lit("of size"), F.col("p_size").cast("string"), F.lit("by"), "p_brand").alias("description"),
        F.array(F.concat(F.lit("size "), F.col("p_size").cast("string")), F.concat(F.lit("kind "), F.lower("p_type"))).alias("key_features"),
        urls.alias("image_urls"), F.lit(None).cast("string").alias("video_url"), F.struct(F.concat_ws(" > ", "p_type", "p_brand", "p_name").alias("name")).alias("category"),
        F.col("p_brand").alias("brand"), F.slice(F.split("p_name", " "), 1, 1).alias("colors"),
        F.array().cast(f"array<{schemas.OPTION}>").alias("options"), F.array().cast(f"array<{schemas.VARIANT}>").alias("variants"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product for each part: id, and the product's columns."""
    return _products(table(spark, sf_dir, "part"))


def altered(products: DataFrame) -> DataFrame:
    """The same products with mistakes that depend on the key, a tenth of them missing."""
    key = F.substring("id", 2, 20).cast("long")
    wrong = lambda m, r, bad, good: F.when(key % m == r, bad).otherwise(good)
    p = F.col("price")
    return products.filter(key % 10 != 9).select(
        "id", wrong(3, 1, F.concat(F.lit("The "), F.col("name")), F.col("name")).alias("name"),
        F.struct(wrong(4, 2, p["price"] + 1, p["price"]).alias("price"), wrong(6, 1, F.lit("EUR"), F.lower(p["currency"])).alias("currency"), wrong(5, 3, F.lit(1.0), p["compare_at_price"]).alias("compare_at_price")).alias("price"),
        wrong(8, 5, F.lit("nothing of the kind"), F.col("description")).alias("description"), wrong(7, 2, F.slice("key_features", 1, 1), F.col("key_features")).alias("key_features"),
        F.transform(wrong(9, 4, F.slice("image_urls", 1, 1), F.col("image_urls")), lambda u: F.replace(u, F.lit("w=640"), F.lit("w=1200"))).alias("image_urls"),
        wrong(11, 1, F.lit("https://v.example.com/a.mp4?x=1"), F.col("video_url")).alias("video_url"),
        F.struct(wrong(6, 5, F.get(F.split(F.col("category.name"), " > "), F.lit(0)), wrong(6, 4, F.lit("Other"), F.col("category.name"))).alias("name")).alias("category"), "brand",
        wrong(5, 2, F.concat("colors", F.array(F.lit("Teal"))), F.transform("colors", lambda c: F.upper(c))).alias("colors"), "options", "variants",
    )


def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, options, variants: for each part its lines as variants by flag and status; a line's number tells stock and images."""
    line = table(spark, sf_dir, "lineitem")
    selection = lambda name, col: F.struct(F.lit(name).alias("name"), F.col(col).alias("value"))
    images = F.array(F.concat(F.lit(f"{HOST}/v/"), F.col("l_returnflag"), F.lit(".jpg")), F.concat(F.lit(f"{HOST}/v/{{size}}/"), F.col("l_linestatus"), F.lit(".jpg")))
    one = F.struct(
        F.array(selection("Flag", "l_returnflag"), selection("Status", "l_linestatus")).alias("selections"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("sku"),
        F.col("price").alias("price"), F.col("stock").alias("available"), images.alias("image_urls"),
    )
    grouped = line.groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(F.max("l_extendedprice").alias("price"), F.bool_or(F.col("l_quantity") > 25).alias("stock"))
    packed = grouped.groupBy("l_partkey").agg(
        F.array_sort(F.collect_list(one)).alias("variants"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.array_sort(F.collect_set("l_linestatus")).alias("states"),
    )
    option = lambda name, col: F.struct(F.lit(name).alias("name"), F.col(col).alias("values"))
    return packed.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.array(option("Flag", "flags"), option("Status", "states")).alias("options"), "variants")


def media_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, seq, url, kind, origin, width, path_hint: a sighting for each line of an order."""
    # named before the window, so that what is grouped by page finds the rows dealt by it
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page")
    pk, n = F.col("l_partkey"), F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    seq = F.row_number().over(_lines()).cast("int") - 1
    ext = F.when(q % 11 == 0, ".mp4").otherwise(".jpg")
    url = F.concat(F.lit(f"{HOST}/p/"), (pk % 50).cast("string"), F.lit("/shot"), (n % 3).cast("string"), ext, F.when(q % 2 == 0, F.concat(F.lit("?w="), (q * 10).cast("string"))).otherwise(""))
    origin = F.element_at(F.array(*map(F.lit, ("blob", "json_ld", "dom", "meta"))), (q % 4 + 1).cast("int"))
    hint = F.when(q % 5 == 0, ".relatedProducts.image").when(q % 7 == 0, ".selectedVariant.image").otherwise(".product.image")
    return line.select(
        "page", seq.alias("seq"), url.alias("url"), F.when(q % 11 == 0, "video").otherwise("image").alias("kind"), origin.alias("origin"),
        F.when(q % 3 == 0, q * 10).alias("width"), hint.alias("path_hint"),
    )


def _lines():
    return Window.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: a product page for each part, with metadata twice, JSON-LD, a script and images."""
    p = _products(_parts(spark, sf_dir))
    image = F.coalesce(F.get("image_urls", F.lit(0)), F.lit(""))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), "name", "description", F.struct(F.lit("Brand").alias("@type"), F.col("brand").alias("name")).alias("brand"), F.col("image_urls").alias("image"),
                            F.array(F.struct(F.format_string("%.2f", F.col("price.price")).alias("price"), F.col("price.currency").alias("priceCurrency"))).alias("offers")))
    html = F.concat(
        F.lit('<html><head><title>'), F.col("name"), F.lit(' | Shop</title><meta property="og:title" content="'), F.col("name"), F.lit('"><meta property="og:title" content="second"><meta name="robots" content="all"><meta name="Description" content=" '),
        F.col("description"), F.lit(' "><script type="application/ld+json">{"@graph":['), ld, F.lit(',{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"}]},{"@type":"WebSite"}]}</script></head><body><nav>Menu<a href="/x">x</a></nav><h1>'),
        F.col("name"), F.lit('</h1><p>'), F.col("description"), F.lit('<p>Price '), F.format_string("%.2f", F.col("price.price")), F.lit('<img src="'), image, F.lit('" srcset="'), image, F.lit(' 640w, '), image, F.lit(' 2x" alt="Front view"><footer>Legal</footer></body></html>'),
    )
    return p.select(F.col("id").alias("page_id"), html.alias("html"))


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: a page for each part that speaks in all channels; structured data plain, in CDATA, escaped or broken, by the key."""
    part = _parts(spark, sf_dir)
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    lit, host = F.lit, f"{HOST}/r/"
    ld = F.concat(lit('{"@type":"Product","name":"'), F.col("p_name"), lit(f'","image":["{host}'), n, lit(f'/a.jpg","//{host[8:]}'), n, lit('/b.jpg?w=100"]}'))
    told = F.when(k % 11 == 0, lit("{broken")).when(k % 3 == 1, F.concat(lit(" <![CDATA["), ld, lit("]]> "))).when(k % 3 == 2, F.replace(ld, lit('"'), lit("&quot;"))).otherwise(ld)
    state = F.concat(lit('window.state = {"product":{"sku":"'), n, lit(f'","price":1,"image":"{host}'), n, lit(f'/a.jpg","gallery":{{"image":"{host}'), n, lit('/c.png?width=5"}},"filler":"' + "x" * 600 + '"};'))
    parts = [
        "<title>", F.col("p_name"), f'</title><link rel="alternate"><link rel="nofollow Canonical canonical" href=" https://shop.example.com/', n, f' "><meta property="og:image" content="{host}', n,
        '/hero.jpg?quality=80"><script type="application/ld+json">', told, '</script><script id="state">', state, "</script><script>", F.when(k % 4 == 0, lit("price sku variant image product currency " * 9)).otherwise("short"),
        "</script><nav>Menu</nav><h1>", F.col("p_name"), f'</h1><img src="{host}', n, f'/a.jpg?w=64" data-src="//{host[8:]}', n, f'/d.webp" srcset="{host}', n, f'/a.jpg 640w, {host}', n, f'/a.jpg?w=64 32w,{host}', n,
        '/e.jpg 2x" aria-label="ab" alt="View of ', F.col("p_brand"), '" title="View of ', F.col("p_brand"), f'"><video src="{host}', n, f'/v.mp4" aria-label="Clip"><source type="video/webm" src="{host}', n,
        f'/v.webm"></video><p title="Price note">Costs ', n, f'<p>Costs ', n, f'<div role="banner">Top<img src="{host}', n, '/1x1.gif"></div><footer>Legal',
    ]
    return part.select(F.concat(lit("p"), n).alias("page_id"), F.concat(*(lit(x) if isinstance(x, str) else x for x in parts)).alias("html"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: kinds of parts, three levels deep, and the top levels."""
    part = table(spark, sf_dir, "part")
    full = part.select(F.concat_ws(" > ", "p_type", "p_brand", "p_name").alias("path"))
    return full.unionByName(part.select(F.col("p_type").alias("path"))).distinct()
