"""Nearest vectors by cosine: exact, or through inverted lists; and a table of embeddings that only makes what is new.

Both searches are one equi-join. A row has a list (the nearest of the trained centroids; all rows have the same one in the exact search),
a query the lists that it asks. Lists that are long on either side are cut into blocks: keys (list, block of paths, block of queries), so a
group holds a bounded number of each and no list, however hot, is one task's. A group returns its k best paths for each query, and
these are ranked together. Nothing but centroids and the sizes of lists goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.functions import text
from lodestrata.functions.materialize import materialized

VECTOR_K = 50
EPSILON = 1e-9
#: Rows of a block, of either side; scores of so many pairs are in memory at once.
PATH_BLOCK, QUERY_BLOCK, TILE = 1 << 15, 1 << 12, 1 << 20
#: Bounds of training: vectors that the centroids are learned from, and centroids.
SAMPLE_VECTORS, MOST_LISTS, ROUNDS = 20_000, 1024, 12
#: Share of the nearest that the lists asked should hold, measured on so many vectors of the sample with so many nearest each.
TARGET_RECALL, MEASURED, MEASURED_K = 0.95, 200, 10
#: Scores that agree in so many digits are ties.
DIGITS = 12


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in the JVM, with a small number in the denominator."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(EPSILON))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row for each array of a column; all have the same length, and no value in them is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x**2).sum(axis=1, keepdims=True)) + EPSILON)


@dataclass(frozen=True)
class Lists:
    """Centroids of the lists, and how many of the nearest a query should ask."""

    centroids: np.ndarray
    probes: int


def train_lists(paths: DataFrame, n_lists: int | None = None, sample: int = SAMPLE_VECTORS, recall: float = TARGET_RECALL) -> Lists:
    """Lists by k-means over the directions of at most `sample` vectors (those of the least hashes); the root of their number if n_lists isn't given.

    How many lists a query must ask is measured: the least number that holds `recall` of the nearest, within the sample. No vectors give no
    centroids, and fewer different ones than lists give as many.
    """
    rows = paths.filter("embedding is not null").select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    if not rows.num_rows:
        return Lists(np.empty((0, 0)), 1)
    x = np.unique(_unit(_matrix(rows.column(0))), axis=0)
    n = min(n_lists or int(np.sqrt(rows.num_rows)) or 1, MOST_LISTS, len(x))
    rng = np.random.default_rng(7)
    centroids = x[rng.permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=n) > 0
        centroids[held] = _unit(sums[held])
    own, asked = (x @ centroids.T).argmax(axis=1), x[rng.permutation(len(x))[:MEASURED]]
    nearest = np.argpartition(-(asked @ x.T), min(MEASURED_K, len(x)) - 1, axis=1)[:, :MEASURED_K]
    # the place of the list of each of the nearest among the lists by their distance from the query
    places = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    wanted = np.sort(np.take_along_axis(places, own[nearest], axis=1).ravel())
    return Lists(centroids, int(wanted[int(np.ceil(recall * len(wanted))) - 1]) + 1)


def with_lists(rows: DataFrame, lists: Lists, most: int = 1) -> DataFrame:
    """rows (with a column embedding) and `list`: the nearest centroid, or a row for each of the `most` nearest. Rows without a vector go."""
    rows = rows.filter("embedding is not null")
    if len(lists.centroids) <= 1:
        return rows.withColumn("list", F.lit(0))
    sent, at = rows.sparkSession.sparkContext.broadcast(lists.centroids), rows.columns.index("embedding")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch.column(at))) @ sent.value.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "list"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, list array<int>").withColumn("list", F.explode("list"))


def _best(asked: np.ndarray, known: np.ndarray, names: list, k: int) -> list[tuple[int, int, float, float]]:
    """(row of asked, row of known, score, rounded score) of the k best for each row of asked; ties by name."""
    if not len(asked) or not len(known):
        return []
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    own, other = np.sqrt((asked**2).sum(axis=1)), np.sqrt((known**2).sum(axis=1))
    step, out = max(1, TILE // len(known)), []
    for lo in range(0, len(asked), step):
        near = asked[lo : lo + step] @ known.T / (own[lo : lo + step, None] * other + EPSILON)
        for i, row in enumerate(near, lo):
            # products of matrices may round by place; what may be among the k is worked out once more, in a fixed order
            at = np.flatnonzero(row >= np.partition(row, -k)[-k] - 1e-9) if len(row) > k else np.arange(len(row))
            scores = np.einsum("d,pd->p", asked[i], known[at]) / (own[i] * other[at] + EPSILON)
            rounded = np.round(scores, DIGITS)
            best = np.lexsort((place[at], -rounded))[:k]
            out += zip([i] * len(best), at[best].tolist(), scores[best].tolist(), rounded[best].tolist(), strict=True)
    return out


def _met(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """q, path, score, rank: the k best paths of each query among those of its lists. asked: q, embedding, list; known: path, embedding, list."""
    spark = asked.sparkSession
    kinds = {"q": asked.schema["q"].dataType, "path": known.schema["path"].dataType}
    # of bounded size: a row for each list
    sizes = asked.groupBy("list").agg(F.count(F.lit(1)).alias("a")).join(known.groupBy("list").agg(F.count(F.lit(1)).alias("b")), "list")
    cuts = F.broadcast(spark.createDataFrame(sizes.collect(), "list int, a long, b long"))
    blocks = lambda n, most: F.ceil(F.col(n) / most)

    def dealt(rows: DataFrame, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
        place = F.pmod(F.xxhash64(*rows.drop("list").columns), own_blocks)
        # by new names, as both sides may come from the same rows
        return rows.join(cuts, "list").select(*(F.col(c).alias(c) for c in rows.columns), place.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), other_blocks - 1)).alias(other))

    left = dealt(asked, "qs", blocks("a", QUERY_BLOCK), "ps", blocks("b", PATH_BLOCK)).withColumn("same", F.xxhash64("embedding"))
    right = dealt(known, "ps", blocks("b", PATH_BLOCK), "qs", blocks("a", QUERY_BLOCK))
    arrow = [to_arrow_type(kinds["q"]), pa.int64(), to_arrow_type(kinds["path"]), pa.float64(), pa.float64()]
    names = ["q", "same", "path", "score", "rounded"]

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in arrow], names=names)
        paths = b.column("path").to_pylist()
        rows = _best(_matrix(a.column("embedding")), _matrix(b.column("embedding")), paths, k)
        q, same = a.column("q").to_pylist(), a.column("same").to_pylist()
        columns = [[q[r[0]] for r in rows], [same[r[0]] for r in rows], [paths[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=names)

    shape = f"q {kinds['q'].simpleString()}, same long, path {kinds['path'].simpleString()}, score double, rounded double"
    found = left.groupBy("list", "ps", "qs").cogroup(right.groupBy("list", "ps", "qs")).applyInArrow(solve, shape)
    order = Window.partitionBy("q", "same").orderBy(F.col("rounded").desc(), "path")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q", "path", "score", "rank")


def vector_topk(queries: DataFrame, paths: DataFrame, k: int = VECTOR_K) -> DataFrame:
    """q, path, score, rank: the k paths of each query with the greatest cosine (to DIGITS digits), ties by path. Exact: every pair is compared, in blocks.

    queries: q, embedding; paths: path, embedding; vectors of one length. Rows without a vector are left out. Queries that repeat are one;
    such that share q with other vectors are ranked apart. No query or no path gives no rows.
    """
    asked = queries.filter("embedding is not null").select("q", "embedding").dropDuplicates(["q", "embedding"])
    return _met(asked.withColumn("list", F.lit(0)), paths.filter("embedding is not null").select("path", "embedding").withColumn("list", F.lit(0)), k)


def list_topk(queries: DataFrame, listed: DataFrame, lists: Lists, k: int = VECTOR_K, probes: int | None = None) -> DataFrame:
    """vector_topk() among the paths of the nearest lists of each query, as many as `lists` says or `probes`; all lists make it exact.

    listed: with_lists(paths, lists), which may be stored and read again.
    """
    asked = queries.filter("embedding is not null").select("q", "embedding").dropDuplicates(["q", "embedding"])
    return _met(with_lists(asked, lists, probes or lists.probes), listed.select("path", "embedding", "list"), k)


# --- embeddings ------------------------------------------------------------------------------------

#: From texts (a column text, each once) to text and embedding. A model's client has this shape.
Embedder = Callable[[DataFrame], DataFrame]


def hashed_vector(words: Column, size: int = 32) -> Column:
    """An array of doubles: each word adds 1 or -1 at a place that its MD5 tells. Needs no model, stays in the JVM, and SQL can say it."""

    def signed(word: Column) -> Column:
        number = F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long")
        return F.struct((number % size).alias("at"), F.when(F.floor(number / size) % 2 == 0, 1.0).otherwise(-1.0).alias("add"))

    places = F.transform(words, signed)
    return text.bound(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(ps, lambda p: p["at"] == i), F.lit(0.0), lambda s, p: s + p["add"])))


def hashing_embedder(size: int = 32) -> Embedder:
    return lambda texts: texts.select("text", hashed_vector(text.singular_words(F.col("text")), size).alias("embedding"))


def embedded(texts: DataFrame, embed: Embedder, cache: str, model: str) -> DataFrame:
    """text, embedding of each distinct text (null texts go), kept in a Parquet table by model and hash of the text: only texts that it lacks are embedded.

    The table has a folder for each model, so that another model's vectors are never read; new rows are appended to it. A run that dies while it
    appends leaves nothing behind, and two that append the same text give it the same vector, of which one is read.
    """
    spark, key = texts.sparkSession, F.sha2(F.col("text").cast("binary"), 256)
    wanted = texts.select("text").filter("text is not null").distinct().withColumn("key", key)
    folder = f"{cache.rstrip('/')}/model={model}"
    kind = "key string, text string, embedding array<double>"
    try:
        held = spark.read.schema(kind).parquet(folder)
    except AnalysisException:  # there is no such folder yet
        held = None
    lacking = wanted if held is None else wanted.join(held.select("key"), "key", "left_anti")
    made = materialized(embed(materialized(lacking).select("text")).select(key.alias("key"), "text", F.col("embedding").cast("array<double>").alias("embedding")))
    if held is None or not made.isEmpty():
        made.write.mode("append").parquet(folder)
        held = spark.read.schema(kind).parquet(folder)
    return wanted.select("key").join(held.dropDuplicates(["key"]), "key").select("text", "embedding")
