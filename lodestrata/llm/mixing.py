"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source expects target / source size copies. The whole part is certain; the fractions are
rounded by the pivotal method: two units at a time, mass moves at random from one to the other until one of
them is 0 or 1, so each unit keeps its expectation and the sum hardly varies. Units meet others of nearly
their own size first, in chunks of about CHUNK units; what remains of a chunk is one unit with a fraction,
and such residuals meet in the next level of a reduction tree until a source has one, which a last draw
settles. No chunk depends on a source's share of the rows, so a hot source only has more chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import unit, word_count, written

CHUNK = 32
#: Classes of document size for each doubling.
CLASSES = 8
_TINY = 1e-12


def source_targets(sizes: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size, target: shares of share x all sizes by weight, none above most x its source's size.

    Weights repeat along the sources in code point order, null last. The excess over a cap is shared among
    the others by weight until none is above: with caps sorted by cap / weight this is one running sum. The
    table has a row for each source, which is what the windows without partitions sort.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*map(F.lit, map(float, weights))), F.pmod(rank - 1, F.lit(len(weights))))
    table = sizes.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * float(most)).alias("_cap"))
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    by_ratio = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    table = table.withColumn("_ratio", F.col("_cap") / F.col("_w")).withColumn("_total", total)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("_level", left / open_weight)
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(Window.partitionBy())["_level"]
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return table.select("source", "source_size", target.alias("target"))


def _fold(units: Column, seed: int, level: int) -> Column:
    """units: array of struct(_o, _h, _p, _u). The sequential pivotal method: struct(c, p, done array of (u, picked))."""
    def meet(acc: Column, x: Column) -> Column:
        both = acc["p"] + x["_p"]
        draw = unit(F.lit(seed), F.lit(level), acc["c"]["_h"], x["_h"])
        # under 1: one of them takes all mass and the other none; else one becomes 1 and the other has the rest
        low = both < 1 - _TINY
        first = F.when(low, draw * both >= acc["p"]).otherwise(draw * (2 - both) < 1 - x["_p"])
        return F.struct(
            F.when(first, x).otherwise(acc["c"]).alias("c"),
            F.when(low, both).otherwise(both - 1).alias("p"),
            F.concat(acc["done"], F.array(F.struct(F.when(first, acc["c"]).otherwise(x).alias("u"), F.when(low, 0).otherwise(1).alias("picked")))).alias("done"),
        )

    begin = F.struct(
        F.get(units, F.lit(0)).alias("c"),
        F.get(units, F.lit(0))["_p"].alias("p"),
        F.slice(F.transform(units, lambda x: F.struct(x.alias("u"), F.lit(0).alias("picked"))), 1, 0).alias("done"),
    )
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), begin, meet)


def pivotal_copies(df: DataFrame, group: str, size: str, expected: str, key: str, seed: int = 11) -> DataFrame:
    """df with `copies` long: expected copies of each row, rounded; in each group the sum hardly varies.

    Rows with size 0 or without an expectation get 0. The columns group (null is a group like others), size
    (long), expected (double) and key (which seeds the draws) stay; a column named copies is replaced. Rows
    with equal keys share their chunk, so keys should differ (mix_sources numbers rows that share an id).
    """
    names = [c for c in df.columns if c != "copies"]
    whole = F.floor(F.col(expected) + _TINY).cast("long")
    part = F.col(expected) - whole
    given = df.select(F.struct(*names).alias("_row"), F.col(group).alias("_g"), F.col(size).alias("_s"), F.col(key).alias("_k"), whole.alias("_whole"), F.when(part > _TINY, part).alias("_part"))
    asked = (F.col("_s") > 0) & F.col("_part").isNotNull()
    plain = given.filter(~F.coalesce(asked, F.lit(False))).select("_row", F.when(F.col("_s") > 0, F.coalesce("_whole", F.lit(0))).otherwise(0).cast("long").alias("copies"))
    units = given.filter(asked).withColumn("_class", F.floor(F.log2(F.col("_s").cast("double")) * CLASSES).cast("int"))

    # a row for each group and class of sizes, at most some 500 classes: how many chunks it has, and the chunks before it
    chunks = units.groupBy("_g", "_class").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    chunks = written(chunks.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    most = chunks.groupBy("_g").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0

    other = chunks.select(F.col("_g").alias("_g2"), F.col("_class").alias("_class2"), "_n", "_from")
    placed = units.join(other, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_class") == F.col("_class2")))
    spread = F.pmod(F.xxhash64(F.lit(seed), "_k"), F.col("_n"))
    # large units meet first, so that what is left over for the last draw is small
    leaf = F.struct((-F.col("_s")).alias("_o"), F.xxhash64(F.lit(seed + 1), "_k").alias("_h"), F.col("_part").alias("_p"), F.struct("_row", "_whole").alias("_u"))
    rest = placed.select("_g", (F.col("_from") + spread).alias("_chunk"), leaf.alias("_x"))
    out, level = plain, 0
    while True:
        level += 1
        ordered = F.array_sort(F.collect_list("_x"))
        folded = written(rest.groupBy("_g", "_chunk").agg(ordered.alias("_xs")).select("_g", "_chunk", _fold(F.col("_xs"), seed + 2, level).alias("_f")))
        done = folded.select(F.explode("_f.done").alias("_d")).select("_d.u._u", F.col("_d.picked").alias("_picked"))
        out = out.unionByName(done.select("_u._row", (F.col("_u._whole") + F.col("_picked")).cast("long").alias("copies")))
        if most <= 1:
            last = F.when(unit(F.lit(seed + 3), F.col("_f.c._h")) < F.col("_f.p"), 1).otherwise(0)
            out = out.unionByName(folded.select("_f.c._u._row", (F.col("_f.c._u._whole") + last).cast("long").alias("copies")))
            return out.select("_row.*", "copies")
        carried = F.struct(F.col("_f.c._o").alias("_o"), F.col("_f.c._h").alias("_h"), F.col("_f.p").alias("_p"), F.col("_f.c._u").alias("_u"))
        rest = folded.select("_g", F.floor(F.col("_chunk") / CHUNK).alias("_chunk"), carried.alias("_x"))
        most = -(-most // CHUNK)


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0, seed: int = 11) -> DataFrame:
    """id, source, size (words), source_size, target, copies long: one row for each row of df.

    Null texts have size 0, null sources are a source; rows of size 0 get no copy, and none gets more than
    `most`. A table without words has targets of 0. Other columns are not read. Reruns agree: draws are
    hashes of ids.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # rows that share an id, or have none, are told apart by a number, so that they don't share their draws and their chunk
    again = F.row_number().over(Window.partitionBy("_id", "source", "size").orderBy("_id"))
    docs = written(docs.withColumn("_key", F.struct("_id", again.alias("again"))))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, share, weights, most).withColumnRenamed("source", "_source")
    joined = docs.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    mixed = pivotal_copies(joined.withColumn("_expected", expected), "source", "size", "_expected", "_key", seed)
    return mixed.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies")


def repeated(df: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df with each row as often as plan (mix_sources(df)) says, 0 times included; columns of df only.

    Rows with the same id share the copies of the one that has most.
    """
    plan = plan.groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").alias("_copies"))
    # the row travels as one column, so that no name of its columns can clash
    rows = df.select(F.col(id_col).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    joined = rows.join(plan, F.col("_key").eqNullSafe(F.col("_id")))
    return joined.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings) -> DataFrame:
    """df's rows as often as mix_sources() says."""
    return repeated(df, mix_sources(df, id_col, source_col, text_col, **settings), id_col)
