"""Quality rules: figures of each text, and how often its lines recur across documents of its host.

The figures of a text are taken in Python over Arrow batches, whole text by whole text. The frequencies of
lines are DataFrame aggregations over hashes; texts are never shuffled for them.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import SPACE, WORD, row_map, word_count, written

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: A line is boilerplate if it stands in more than this many different texts of a host, and in more than this share of them,
MOST_TEXTS, MOST_SHARE = 20, 0.05
#: or in more than this many however many the host has: a host's growth doesn't make its footer another line.
ALWAYS_TEXTS = 50
#: A document is depleted if more than this share of its words is in such lines.
MOST_REMOVED = 0.5

_WORDS = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"


def text_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, end = Counter(windows), 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len("".join(words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def normalised(line: Column) -> Column:
    """A line in lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _lines(docs: DataFrame) -> DataFrame:
    """host, key, hash, words: a row for each line with a word."""
    line = F.explode(F.split("_text", "\n")).alias("_line")
    lines = docs.select("_host", "_key", line).withColumn("_line", normalised(F.col("_line"))).filter(F.col("_line") != "")
    return lines.select("_host", "_key", F.xxhash64("_line").alias("_hash"), word_count(F.col("_line")).alias("_words"))


def _keyed(df: DataFrame, host_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(host_col).alias("_host"), F.xxhash64(text).alias("_key"), text.alias("_text"))


def frequent_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, always_texts: int = ALWAYS_TEXTS) -> DataFrame:
    """_host, _key, _removed long, _hashes array: for each text with lines above the limits, the words in them.

    A document counts by its text, so that exact copies of one document count once: a line isn't boilerplate
    because its document was copied. _key is the text's xxhash64. A null host is a host. Texts without such
    lines have no row.
    """
    docs = _keyed(df, host_col, text_col)
    copies = written(docs.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_n")))
    lines = _lines(docs)
    counts = lines.select("_host", "_hash", "_key").distinct().groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("_texts"))
    hosts = copies.groupBy(F.col("_host").alias("_host2")).agg(F.count(F.lit(1)).alias("_all"))
    over = (
        counts.filter(F.col("_texts") > most_texts)
        .join(hosts, F.col("_host").eqNullSafe(F.col("_host2")))
        .filter((F.col("_texts") > F.col("_all") * most_share) | (F.col("_texts") > always_texts))
        .select(F.col("_host").alias("_host2"), F.col("_hash").alias("_hash2"))
    )
    # at most lines / most_texts rows; the join deals by line, and Spark splits a line that is very common
    over = written(over)
    hit = lines.join(over, F.col("_host").eqNullSafe(F.col("_host2")) & (F.col("_hash") == F.col("_hash2")))
    found = hit.groupBy("_host", "_key").agg(F.sum("_words").alias("_sum"), F.collect_set("_hash").alias("_hashes"))
    again = copies.select(F.col("_host").alias("_host2"), F.col("_key").alias("_key2"), "_n")
    joined = found.join(again, F.col("_host").eqNullSafe(F.col("_host2")) & (F.col("_key") == F.col("_key2")))
    return joined.select("_host", "_key", F.expr("_sum div _n").alias("_removed"), "_hashes")


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _depleted(removed: Column) -> Column:
    return removed > F.col("n_words") * MOST_REMOVED


def _figures(df: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keep = [F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), key.alias("_key")]
    return row_map(df, keep, F.col(text_col), lambda: text_figures, _FIGURES)


def quality_rules(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, depleted, kept.

    base_failed: under MIN_WORDS words, or over MOST_REPEATED per cent of them in 3-word windows found twice.
    removed_words: words in lines that too many texts of the host share. depleted: over MOST_REMOVED of the
    words. kept: neither. Null texts are empty and so fail; null hosts are a host; repeated rows get equal
    results; an empty table gives an empty table; other columns are not read.
    """
    figures = _figures(df, id_col, host_col, text_col)
    lines = frequent_lines(df, host_col, text_col).select(F.col("_host").alias("_host2"), F.col("_key").alias("_key2"), "_removed")
    joined = figures.join(lines, F.col("_host").eqNullSafe(F.col("_host2")) & (F.col("_key") == F.col("_key2")), "left")
    removed = F.coalesce("_removed", F.lit(0)).cast("long")
    failed, depleted = _failed(), _depleted(removed)
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        removed.alias("removed_words"), failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
    )


def _left_lines(text: Column, hashes: Column) -> Column:
    """text without the lines whose normalised forms have one of the hashes."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hashes, F.xxhash64(normalised(x)))), "\n")


def _cleaned(df: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """_row (the other columns, as one, so that no name can clash), _input, _text without lines above the limits, _removed_words."""
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    rows = df.select(F.struct(*others, F.lit(None).alias("_")).alias("_row"), F.col(host_col).alias("_host"), F.col(text_col).alias("_input"))
    found = frequent_lines(df, host_col, text_col).select(F.col("_host").alias("_host2"), F.col("_key").alias("_key2"), "_hashes", "_removed")
    joined = rows.join(found, F.col("_host").eqNullSafe(F.col("_host2")) & (F.xxhash64(F.coalesce("_input", F.lit(""))) == F.col("_key2")), "left")
    text = F.when(F.col("_key2").isNull(), F.col("_input")).otherwise(_left_lines(F.col("_input"), F.col("_hashes")))
    return joined.select("_row", "_input", text.alias("_text"), F.coalesce("_removed", F.lit(0)).cast("long").alias("_removed_words"))


def _columns(df: DataFrame, text_col: str) -> list[Column]:
    """The columns of df from _row and _text."""
    return [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns]


def without_frequent_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", removed_col: str = "_removed_words") -> DataFrame:
    """df with lines above the limits taken out of its texts, and a column of how many words went; rows and other columns stay (one of that name is replaced)."""
    found = _cleaned(df.drop(removed_col), host_col, text_col)
    return found.select(*_columns(df.drop(removed_col), text_col), F.col("_removed_words").alias(removed_col))


def kept_documents(df: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of df that quality_rules() keeps, without the lines above the limits; columns stay, whatever their names.

    The figures that decide are those of the input text.
    """
    keep = [F.col("_row"), F.col("_text"), F.col("_removed_words")]
    counted = row_map(_cleaned(df, host_col, text_col), keep, F.col("_input"), lambda: text_figures, _FIGURES)
    return counted.filter(~_failed() & ~_depleted(F.col("_removed_words"))).select(*_columns(df, text_col))
