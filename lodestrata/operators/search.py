"""Substring search over large catalogs by trigrams: postings narrow the rows down, contains() decides.

A row whose text contains a query contains all its trigrams. The rarest ones of the query are looked up; rows that all their
postings have are the candidates. A query under three characters has no trigram and scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text

#: Trigrams of a query that are looked up.
MOST_GRAMS = 3


def trigrams(value: Column) -> Column:
    """Distinct runs of three characters of a lower-cased text."""

    def runs(t: Column) -> Column:
        return F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substr(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    return text.bound(F.lower(F.coalesce(value, F.lit(""))), runs)


@dataclass(frozen=True)
class TrigramIndex:
    """postings: gram, id (a row for each gram of each row); sizes: gram, n."""

    postings: DataFrame
    sizes: DataFrame


def write_index(rows: DataFrame, value: Column, path: str, id_col: str = "id") -> TrigramIndex:
    """Makes the index of rows' values under a path. Postings are sorted by gram, so that a lookup reads the row groups that have it;
    ranges are cut by gram and id, so that a gram which most rows have is no one task's.
    """
    each = rows.select(F.explode(trigrams(value)).alias("gram"), F.col(id_col).alias("id"))
    each.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/postings")
    spark = rows.sparkSession
    sizes = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/sizes")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> TrigramIndex:
    return TrigramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"))


def rarest(index: TrigramIndex, query: str, most: int = MOST_GRAMS) -> list[str] | None:
    """The rarest trigrams of a query; None if one of them is in no row."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    known = {r.gram: r.n for r in index.sizes.filter(F.col("gram").isin(grams)).collect()}
    return sorted(known, key=lambda g: (known[g], g))[:most] if len(known) == len(grams) else None


def substring_search(rows: DataFrame, value: Column, index: TrigramIndex, query: str, id_col: str = "id") -> DataFrame:
    """The rows whose value has the query in it, whatever its case; a blank query keeps all. The index must be of the same rows."""
    wanted = query.strip().lower()
    if not wanted:
        return rows
    found = rows.filter(F.contains(F.lower(value), F.lit(wanted)))
    if len(wanted) < 3:
        return found
    grams = rarest(index, wanted)
    if grams is None:
        return rows.limit(0)
    chosen = index.postings.filter(F.col("gram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    return found.join(chosen.select(F.col("id").alias(id_col)), id_col, "left_semi")
