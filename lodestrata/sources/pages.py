"""Where rows come from: page files, taxonomy files, catalogs of products, ground truth, test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata import schemas
from lodestrata.functions.arrow import over_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stem(path) -> F.Column:
    """A file's name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


#: Bytes to text; bytes that aren't UTF-8 are dropped, not replaced.
decoded = over_values(lambda data: bytes(data).decode("utf-8", "ignore"), "string")


def page_files(spark: SparkSession, *globs: str) -> DataFrame:
    """id, html: a row for each page file; undecodable bytes are dropped."""
    files = spark.read.format("binaryFile").load(list(globs))
    return files.select(stem(F.col("path")).alias("id"), decoded(F.col("content")).alias("html"))


def taxonomy_file(spark: SparkSession, path: str) -> DataFrame:
    """path: distinct lines that aren't blank or comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"))
    return lines.filter("path <> '' and not startswith(path, '#')").distinct()


def _json_files(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    shape = StructType.fromDDL(f"{ddl}, _corrupt string")
    return spark.read.schema(shape).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("id", stem(F.input_file_name()))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """id and the product's columns: JSON files of products; damaged files and such without a name are left out."""
    return _json_files(spark, path, schemas.PRODUCT).filter("_corrupt is null and name is not null").drop("_corrupt")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """id of the files that catalog() leaves out."""
    return _json_files(spark, path, schemas.PRODUCT).filter("_corrupt is not null or name is null").select("id")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """id and the truth's columns, variants as text; keys that aren't listed are ignored."""
    return _json_files(spark, path, schemas.TRUTH).drop("_corrupt")


def expected_categories(spark: SparkSession, path: str) -> DataFrame:
    """id, accepted array: from one JSON object of ids to accepted paths."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("id", "accepted"))


def write_catalog(products: DataFrame, path: str) -> None:
    """Products with their ids as JSON lines. For updates and lookups see sources/store.py."""
    products.write.json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """id and the product's columns of what write_catalog() wrote; damaged lines and such without an id or a name are left out."""
    shape = StructType.fromDDL(f"id string, {schemas.PRODUCT}, _corrupt string")
    lines = spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return lines.filter("_corrupt is null and id is not null and name is not null").drop("_corrupt")
