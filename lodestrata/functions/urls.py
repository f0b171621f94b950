"""URL functions: media kinds, noise, renditions and asset identity, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import bound

# Fixed values.
IMAGE_EXT = r"(?i)\.(?:jpe?g|png|webp|avif|gif)(?:\?|$)"
VIDEO_EXT = r"(?i)\.(?:mp4|webm|m3u8)(?:\?|$)"
IMAGE_PATH = r"(?i)/(?:is/image|images?|media|photos?|files?)/"
NOISE_URL = r"(?i)analytics|beacon|pixel|track|telemetry|metrics|/api/|doubleclick|facebook\.com/tr|pinterest\.com/v3|bat\.bing|noscript=1|\.svg\z"
SIZED_TWIN = r"[?&](?:w|wid|width|h|hei|sw|size|q|quality|max)=\d"
SIZED = r"[?&](?:w|wid|width|h|hei|sw|size)=\d"
SIZE_SEGMENT = r"/\d{2,4}x\d{0,4}/|_\d{2,4}x\d{0,4}(?=\.)|w_\d+|h_\d+"
RENDITION_WORDS = ["mini", "thumb", "thumbnail", "standard", "full", "max", "square", "small", "large", "medium", "micro", "zoom", "default", "original"]
GENERIC_WORDS = ["image", "images", "product", "products", "media", "photo", "photos", "files", "default", "thumb", "large", "small", "assets"]


def without_query(url: Column) -> Column:
    return F.get(F.split(url, r"\?"), F.lit(0))


def absolute(url: Column) -> Column:
    """A trimmed http(s) or scheme-relative URL, else null."""
    url = F.regexp_replace(url, r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$", "")
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(url.rlike("^https?://"), url)


def is_noise(url: Column) -> Column:
    """Tracking pixels, icons and beacons."""
    return F.contains(url, F.lit("1x1")) | url.rlike(NOISE_URL)


def media_kind(url: Column) -> Column:
    """image, video or null, by extension and path."""
    return F.when(url.rlike(VIDEO_EXT), "video").when(url.rlike(IMAGE_EXT) | url.rlike(IMAGE_PATH), "image")


def sized_twin(url: Column) -> Column:
    """The query-free form of a sized image URL, where that has an image's extension; else null."""
    base = without_query(url)
    return F.when(url.rlike(SIZED_TWIN) & F.concat(base, F.lit("?")).rlike(IMAGE_EXT), base)


def asset_key(url: Column) -> Column:
    """What tells a picture from others, whatever host, size, rendition or content hash its URL has."""
    plain = F.regexp_replace(F.get(F.split(without_query(url), "#"), F.lit(0)), SIZE_SEGMENT, "/")

    def tokens(segment: Column) -> Column:
        parts = F.split(F.lower(segment), "[^a-z0-9]+")
        content_hash = lambda t: (F.length(t) >= 6) & t.rlike("^[0-9a-f]+$") & t.rlike("[a-f]")
        return F.filter(parts, lambda t: (t != "") & ~t.isin(RENDITION_WORDS) & ~content_hash(t) & ~t.rlike(r"^\d{2,4}x\d{0,4}$"))

    def named(base: Column) -> Column:
        after_scheme = F.when(F.contains(base, F.lit("//")), F.substr(base, F.locate("//", base) + 2)).otherwise(base)
        path = bound(F.split(after_scheme, "/"), lambda s: F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))))
        words = F.transform(F.filter(path, lambda s: ~s.rlike("[,:=]")), lambda s: F.array_join(tokens(s), "-"))
        kept = F.array_join(F.filter(words, lambda s: s != ""), "/")
        return bound(kept, lambda k: F.when(k != "", k).otherwise(F.lower(base)))

    return bound(plain, named)


def quality(url: Column, origin: Column, width: Column) -> Column:
    """How good a rendition is: structured origins, clean URLs, wide, long paths first."""
    rank = F.when(origin.isin("blob", "json_ld"), 3).when(origin == "dom", 2).when(origin == "meta", 1).otherwise(0)
    return F.struct(rank.alias("origin_rank"), F.when(url.rlike(SIZED), -1).otherwise(0).alias("clean"), F.coalesce(width, F.lit(0)).alias("width"), F.length(without_query(url)).alias("length"))


def hero_stems(*hero_urls: Column) -> Column:
    """Telling words in the last three segments of a page's hero images."""

    def stems(url: Column) -> Column:
        parts = F.split(F.rtrim(without_query(url), F.lit("/")), "/")
        last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
        words = F.flatten(F.transform(last, lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]{4,}"), F.lit(0))))
        return F.filter(words, lambda t: ~t.isin(GENERIC_WORDS) & ~t.rlike(r"^\d{2,4}x\d{2,4}$"))

    urls = F.array_compact(F.array(*hero_urls))
    return F.array_distinct(F.flatten(F.transform(urls, stems)))


def srcset(value: Column) -> Column:
    """array<struct<url,width>> of a srcset attribute; widths only of the form 640w."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")

    def entry(part: Column) -> Column:
        pieces = F.split(part, r"\s+")
        width = F.regexp_extract(F.coalesce(F.get(pieces, F.lit(1)), F.lit("")), r"^(\d+)w$", 1)
        return F.struct(F.get(pieces, F.lit(0)).alias("url"), width.try_cast("int").alias("width"))

    return F.transform(parts, entry)
