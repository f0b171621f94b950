"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records by a seeded hash of their content over buckets of about `bucket_rows` rows and at most about
`bucket_bytes` bytes, so that a bucket fits memory whatever the keys are: no key or source shares a bucket because of
its value. Buckets that records equal in every column fill beyond that are split by the records' places.
Pass two puts each bucket in a defined order and runs a Fisher-Yates shuffle over it. The buckets one
after another are a uniform random order of all records, which is cut into shards whose counts are at
most one apart.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import shared_dir, written

BUCKET_ROWS = 256
BUCKET_BYTES = 4 << 20
#: A bucket of over so many times the rows or bytes is split.
OVER = 4
#: Buckets whose offsets one task sums up.
GROUP = 4096
#: Offsets of up to so many buckets (16 bytes each) are sent to all executors; with more, they are joined, which shuffles the records once more.
BROADCAST_BUCKETS = 1_000_000


def fisher_yates(items: Column, seed: Column) -> Column:
    """items in an order drawn by a Fisher-Yates shuffle: from the last place down, swap with a place at or before it.

    The draws are hashes of the seed and the place, so a task that runs again draws alike.
    """

    def swap(a: Column, i: Column) -> Column:
        # places from 0: i is the current place, j the drawn one
        j = F.pmod(F.xxhash64(seed, i), (i + 1).cast("long")).cast("int")
        swapped = F.concat(
            F.slice(a, F.lit(1), j), F.slice(a, i + 1, F.lit(1)), F.slice(a, j + 2, i - j - 1),
            F.slice(a, j + 1, F.lit(1)), F.slice(a, i + 2, F.size(a)),
        )
        return F.when(j < i, swapped).otherwise(a)

    places = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, items, swap)


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    sizes = [F.lit(16 + 8 * len(df.columns)).cast("long")]
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary", "array", "struct"):
            sizes.append(F.coalesce(F.octet_length(c if kind in ("string", "binary") else F.to_json(F.struct(c))), F.lit(0)).cast("long"))
    return reduce(lambda a, b: a + b, sizes)


def buckets(df: DataFrame, id_col: str, seed: int, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """_bucket long, _r: the records of df, each with a hash _h before its columns, in buckets bounded by rows and bytes; and how many they are."""
    content = [F.col(f"`{c}`") for c in (id_col, *(c for c in df.columns if c != id_col))]
    found = df.select(_bytes(df).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("b")).first()
    total = found.n
    n_buckets = max(1, -(-total // bucket_rows), -(-found.b // bucket_bytes))
    spread = F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(n_buckets)).cast("long")
    record = F.struct(F.xxhash64(F.lit(seed + 1), *content).alias("_h"), *(F.col(f"`{c}`") for c in df.columns)).alias("_r")

    sizes = df.select(spread.alias("_bucket"), _bytes(df).alias("_b")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_b"))
    parts = F.greatest(F.ceil(F.col("_n") / bucket_rows), F.ceil(F.col("_b") / bucket_bytes))
    over = written(sizes.filter((F.col("_n") > OVER * bucket_rows) | ((F.col("_b") > OVER * bucket_bytes) & (F.col("_n") > 1))).select(F.col("_bucket").alias("_over"), parts.alias("_parts")))
    given = df.select(spread.alias("_bucket"), record)
    most = over.agg(F.max("_parts")).first()[0]
    if most:
        # the parts of a bucket take places of their own, one after another; places of rows are drawn once and written down
        at = given.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(over), F.col("_bucket") == F.col("_over"), "left")
        part = F.coalesce(F.pmod(F.xxhash64(F.lit(seed + 3), F.col("_row")), F.col("_parts")), F.lit(0)).cast("long")
        given = written(at.select((F.col("_bucket") * F.lit(int(most)) + part).alias("_bucket"), "_r"))
    return given, total


def external_shuffle(df: DataFrame, id_col: str, n_shards: int, seed: int = 7, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with `shard` int and `slot` long: a seeded random order of all rows, cut into n_shards.

    Counts of shards are at most one apart; slots run from 0 without gaps. Every row of df comes out once;
    rows with null or repeated ids and rows that repeat altogether are rows like others. An empty table gives
    an empty table. Columns of df keep their names and values, but for columns named shard or slot, which
    are replaced. The order depends on the rows and the seed only, but in buckets split for rows that repeat.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    given, total = buckets(df.select(*(F.col(f"`{c}`") for c in kept)), id_col, seed, bucket_rows, bucket_bytes)

    counts = given.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_g")).select("_group", F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(groups, "_group")
        .select("_bucket", (F.col("_base") + F.col("_in")).alias("_start"))
    )

    starts = written(starts)
    few = starts.count() <= BROADCAST_BUCKETS

    # buckets are dealt in their order, so that a task writes a stretch of a shard or two and records move once
    given = given.repartitionByRange("_bucket")
    order = F.array_sort(F.collect_list("_r"))
    # places are drawn, not records: a swap then moves no text
    places = fisher_yates(F.sequence(F.lit(0), F.size("_rows") - 1), F.xxhash64(F.lit(seed + 2), F.col("_bucket")))
    drawn = given.groupBy("_bucket").agg(order.alias("_rows")).select("_bucket", F.transform(places, lambda i: F.get("_rows", i)).alias("_rows"))
    at = drawn.join(F.broadcast(starts) if few else starts, "_bucket").select("_start", F.posexplode("_rows").alias("_i", "_r")).select((F.col("_start") + F.col("_i")).alias("_at"), "_r")
    shard = F.expr(f"(_at * {n_shards}) div {max(1, total)}")
    first = F.expr(f"(_shard * {total} + {n_shards - 1}) div {n_shards}")
    placed = at.withColumn("_shard", shard).select(*(F.col(f"_r.`{c}`").alias(c) for c in kept), F.col("_shard").cast("int").alias("shard"), (F.col("_at") - first).cast("long").alias("slot"))
    return placed if few else placed.repartitionByRange("shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Writes what external_shuffle() returns, a folder for each shard; its files hold stretches of slots, in their order."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded(df: DataFrame, id_col: str, n_shards: int, seed: int = 7) -> DataFrame:
    """df shuffled, written as shards to the shared folder, and read again."""
    placed = external_shuffle(df, id_col, n_shards, seed)
    path = f"{shared_dir(df.sparkSession)}/lodestrata-shards-{uuid.uuid4().hex}"
    write_shards(placed, path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)
