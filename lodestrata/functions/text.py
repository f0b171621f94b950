"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IDENTITY_STOPWORDS = ["the", "and", "for", "with", "men", "mens", "women", "womens", "s"]
IDENTITY_SHARE = 0.3
DENSITY_WORDS = ["price", "sku", "variant", "image", "product", "currency"]
DENSITY_CHARS = 100_000
COMMERCE_WORDS = [
    "price", "prices", "sku", "skus", "variant", "variants", "offers", "image", "images", "media",
    "stock", "availability", "currency", "brand", "color", "colors", "size", "sizes", "product", "products",
]
NOISE_KEY_WORDS = [
    "nav", "menu", "footer", "header", "i18n", "translation", "messages", "locale", "dictionary", "analytics", "tracking", "gtm", "experiment",
    "featureflag", "abtest", "consent", "cookies?", "router", "routes", "routing", "webpack", "chunks", "assets", "styles", "registry", "warehouses?",
]
NOISE_KEY = "(?i)(?:^|_)(?:" + "|".join(NOISE_KEY_WORDS) + ")(?:$|_)"
RELATED_PATH = "(?i)related|recommend|upsell|cross|similar|recently|alsolike|youmay"
SELECTED_PATH = "(?i)selected|current|active"


def norm(text: Column) -> Column:
    """Lower case, anything but word characters as spaces, collapsed and trimmed; null as empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def word_set(text: Column) -> Column:
    """Distinct words of a normalised text."""
    return F.filter(F.array_distinct(F.split(norm(text), " ")), lambda w: w != "")


def alnum_words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def identity_tokens(*texts: Column) -> Column:
    """Distinct words over two letters that aren't stopwords: what a page says that it is about."""
    words = alnum_words(F.concat_ws(" ", *texts))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(IDENTITY_STOPWORDS)))


def matches_identity(name: Column, identity: Column) -> Column:
    """Whether enough of a name's words are identity tokens; true if either side is empty."""
    own = F.array_distinct(F.filter(alnum_words(name), lambda w: F.length(w) > 2))
    share = F.size(F.array_intersect(own, identity)) / F.nullif(F.size(own), F.lit(0))
    return (F.size(own) == 0) | (F.size(identity) == 0) | F.coalesce(share >= IDENTITY_SHARE, F.lit(True))


def key_norm(key: Column) -> Column:
    """camelCase and dashes to lower snake case."""
    return F.lower(F.replace(F.regexp_replace(key, "([a-z0-9])(?=[A-Z])", "$1_"), F.lit("-"), F.lit("_")))


def is_noise_key(key: Column) -> Column:
    """Whether a JSON key names navigation, translations, tracking and the like."""
    return key_norm(key).rlike(NOISE_KEY)


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def keyword_density(text: Column) -> Column:
    """Commerce words in the first part of a text over the logarithm of its length."""
    sample = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, DENSITY_CHARS))
    hits = lambda s: sum((occurrences(s, w) for w in DENSITY_WORDS[1:]), occurrences(s, DENSITY_WORDS[0]))
    return bound(sample, lambda s: hits(s) / F.log(F.length(s) + 10))


def commerce_score(keys: Column) -> Column:
    """Distinct keys that contain a commerce word, over the root of their number; 0 without keys."""
    words = F.array(*map(F.lit, COMMERCE_WORDS))
    hits = lambda ks: F.size(F.filter(F.transform(ks, F.lower), lambda k: F.exists(words, lambda w: F.contains(k, w))))
    return bound(F.array_distinct(keys), lambda ks: F.when(F.size(ks) == 0, 0.0).otherwise(hits(ks) / F.sqrt(F.size(ks))))


def fit(text: Column, budget: int | Column) -> Column:
    """A text cut to so many characters, with a mark where it was cut."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.left(text, budget), F.lit("\n…[truncated]")))


def dedupe_lines(text: Column) -> Column:
    """Lines trimmed, blank ones and repeats of the line before dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))
    return F.array_join(kept, "\n")


def section(title: str, body: Column) -> Column:
    """A labelled section, null where the body is empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"== {title} ==\n"), body))


def singular_words(text: Column) -> Column:
    """Distinct words over two letters, without the final s of those over three."""
    words = F.filter(alnum_words(text), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 3) & F.endswith(w, F.lit("s")), F.left(w, F.length(w) - 1)).otherwise(w)))


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once per row however often use names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_zeros(number: Column) -> Column:
    return F.regexp_replace(F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, "0+$", "")).otherwise(number), r"\.$", "")


def general_format(value: Column) -> Column:
    """Six significant digits without trailing zeros, as printf's %g: rounded by the double's exact value, ties to even. (Under 0.0001 a tie goes by the shortest decimal form.)"""
    value = value.cast("double")
    size = F.abs(value)
    exponent = F.when(size >= 1e6, F.lit(None).cast("int"))
    for e in range(5, -5, -1):
        exponent = exponent.when(size >= 10.0**e, e)
    # format_number rounds a double by its exact value
    fixed = F.replace(F.call_function("format_number", value, 5 - exponent), F.lit(","), F.lit(""))
    # over a million ties are whole numbers, which decimals hold exactly
    whole = F.when(size.between(1e6, 1e15), value).cast("decimal(38,10)")
    rounded = F.when(size < 1e7, F.bround(whole, -1))
    for e in range(7, 15):
        rounded = rounded.when(size < 10.0 ** (e + 1), F.bround(whole, 5 - e))
    science = F.format_string("%.5e", F.coalesce(rounded.cast("double"), value))
    mantissa = _without_zeros(F.regexp_extract(science, r"^(-?[\d.]+)e", 1))
    other = F.concat(mantissa, F.lit("e"), F.regexp_extract(science, r"e([+-]\d+)$", 1))
    return F.when(value == 0, "0").when(fixed.rlike("^-?1000000$"), F.replace(fixed, F.lit("1000000"), F.lit("1e+06"))).when(fixed.isNotNull(), _without_zeros(fixed)).otherwise(other)


def two_decimals(value: Column) -> Column:
    """As printf's %.2f: rounded by the double's exact value."""
    return F.replace(F.format_number(value.cast("double"), 2), F.lit(","), F.lit(""))


def price_forms(value: Column, thousands: bool = False) -> Column:
    """Distinct ways in which a page may write a price: plain, two decimals, decimal comma, minor units, whole; from 1000 on with separators."""
    value = value.cast("double")
    two = two_decimals(value)
    whole = F.when(value == F.floor(value), F.floor(value).cast("string"))
    forms = [general_format(value), two, F.replace(two, F.lit("."), F.lit(",")), F.bround(value * 100, 0).cast("bigint").cast("string"), whole]
    if thousands:
        exact = F.format_number(value, 2)
        grouped = F.regexp_replace(exact, r"\.\d+$", "")
        forms += [F.when(value >= 1000, x) for x in (exact, grouped, F.replace(grouped, F.lit(","), F.lit(".")))]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def on_page(value: Column, text: Column, thousands: bool = True) -> Column:
    """Whether a text has a number in any of its forms."""
    return F.exists(price_forms(value, thousands), lambda f: F.contains(text, f))


def breadcrumb_hint(text: Column) -> Column:
    """Up to eight names after the word BreadcrumbList, joined as a path."""
    window = F.regexp_extract(text, r'(?s)"BreadcrumbList".{0,2000}', 0)
    names = F.regexp_extract_all(window, F.lit(r'"name"\s*:\s*"([^"]{2,60})"'), F.lit(1))
    return F.array_join(F.slice(names, 1, 8), " > ")
