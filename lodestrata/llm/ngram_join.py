"""N-gram Jaccard join of documents with filters under several global orders of the n-grams.

Two sets with Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 tokens of each, under
any order that holds for all documents. A pair is a candidate only if it shares a prefix token under each of three
orders: rare first (by a fixed-size table of counts over the whole corpus), and two pseudo-random ones. Pairs are
made from the first order's prefixes, where the places of the shared token must leave room for enough others; the other
two orders intersect them, and exact sets verify what is left.

A token that c documents share never makes c * c pairs. First each meets the token's least document; what
these links connect is one component; only documents of different components meet then. Copies (equal sets)
are one document throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import dropped, own_shuffles, row_map, small_batches, written
from lodestrata.llm.components import components

SHINGLE = 3
#: Counters of the corpus-wide table of token counts: the driver and each worker hold one table of this size.
SLOTS = 1 << 19

#: Ids of candidates up to this many are sent to all executors to pick out their texts, so that other texts aren't shuffled; more are joined.
BROADCAST_IDS = 200_000

_IS_SPACE = np.zeros(256, np.int8)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sorted arrays of 64-bit hashes of their distinct shingles of lower-cased words.

    A word's hash is a polynomial over its bytes, taken as a difference of running sums, so whole texts go through numpy.
    """

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _upto(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        n = len(data)
        self._upto(n)
        gaps = np.ones(n + 2, np.int8)
        gaps[1:-1] = _IS_SPACE[data]
        edges = np.flatnonzero(gaps[1:] != gaps[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.powers[:n], out=sums[1:])
        words = _mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        k = min(self.size, len(words))
        rows = len(words) - k + 1
        out = np.full(rows, k, np.uint64)
        for i in range(k):
            out = _mixed(out * _M[i % 3] + words[i : i + rows])
        return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n of which another set with that Jaccard similarity or more has one in its own."""
    return n + 1 - -(-n * percent // 100) if n else 0


def token_counts(df: DataFrame, text_col: str, size: int) -> np.ndarray:
    """SLOTS counters of all documents' shingles by hash, counted in each task and summed by slot."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingler(size), np.zeros(SLOTS, np.int64)
        for batch in batches:
            found = [shingles(x) for x in batch.column(0).to_pylist()]
            if found:
                total += np.bincount((np.concatenate(found) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    with own_shuffles(df.sparkSession):
        rows = df.select(text_col).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _prefixes(df: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """_id, n long, key binary, p1 array<bigint>, p2 and p3 array<int>: set sizes, set digests, prefixes under the three orders."""
    counts = df.sparkSession.sparkContext.broadcast(token_counts(df, text_col, size))

    def make():
        shingles, table = Shingler(size), counts.value

        def one(text: str | None) -> tuple:
            tokens = shingles(text)
            n = len(tokens)
            if not n:
                return 0, None, [], [], []
            p = prefix_length(n, percent)
            first = tokens[np.lexsort((tokens, table[(tokens % np.uint64(SLOTS)).astype(np.int64)]))[:p]]
            others = []
            for m in _ORDERS:
                drawn = _mixed(tokens * m)
                low = np.partition(drawn, p - 1)[:p]
                others.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist())
            return n, xxhash.xxh3_128_digest(tokens.tobytes()), first.view(np.int64).tolist(), *others

        return one

    return row_map(df, [F.col(id_col).alias("_id")], F.col(text_col), make, "n long, key binary, p1 array<bigint>, p2 array<int>, p3 array<int>")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """a, b, written: the pairs (a, b) that pass the other orders' filters and whose exact sets are similar."""
    for side in ("a", "b"):
        own = reps.select(F.col("_id").alias(side), F.col("p2").alias(f"p2{side}"), F.col("p3").alias(f"p3{side}"))
        pairs = pairs.join(own, side)
    pairs = pairs.filter(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b")).select("a", "b")
    pairs = written(pairs)
    wanted = written(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct())
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    few = written(texts.join(chosen, "_id", "left_semi").dropDuplicates(["_id"]))
    for side in ("a", "b"):
        pairs = pairs.join(few.select(F.col("_id").alias(side), F.col("_text").alias(f"text_{side}")), side)

    def make():
        shingles, kept = Shingler(size), {}

        def sets(of, text: str) -> np.ndarray:
            of = tuple(of.values()) if isinstance(of, dict) else of
            if of not in kept:
                if len(kept) > 2000:
                    kept.clear()
                kept[of] = shingles(text)
            return kept[of]

        def one(x: dict) -> bool:
            a, b = sets(x["a"], x["text_a"]), sets(x["b"], x["text_b"])
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        return one

    links = written(row_map(pairs, [F.col("a"), F.col("b")], F.struct("a", "b", "text_a", "text_b"), make, "similar boolean").filter("similar").select("a", "b"))
    dropped(few)
    return links


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, size: int = SHINGLE) -> DataFrame:
    """One row for each row of df: id, n_shingles long, component_id.

    Documents link when percent of their sets' union is in the intersection. component_id is the least id reachable by
    links, its own included. Documents without words have size 0 and link with nothing, equal ones included;
    texts under `size` words are one shingle. A null id keeps its row and is never a component of others.
    Rows that share an id are one document to links, whatever their texts: what any of them links to is reachable from all.
    Rows that repeat get equal results. Empty tables give empty tables; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if not _with_different_texts(rows):
        return _row_components(rows, "_id", "_text", percent, size).withColumnRenamed("_id", id_col)
    # each text of an id is joined by itself, then what an id's texts belong to is united
    apart = rows.withColumn("_id", F.when(F.col("_id").isNotNull(), F.struct("_id", F.xxhash64("_text").alias("text_hash"))))
    found = written(_row_components(apart, "_id", "_text", percent, size).select(F.col("_id._id").alias("_id"), "n_shingles", F.col("component_id._id").alias("_near")))
    links = found.filter("_near <> _id").select(F.col("_id").alias("a"), F.col("_near").alias("b")).distinct()
    groups = components(links).withColumnsRenamed({"id": "_member", "component": "_least"})
    joined = found.join(groups, F.col("_id") == F.col("_member"), "left")
    return joined.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("_least", "_id").alias("component_id"))


def _with_different_texts(rows: DataFrame) -> bool:
    """Whether an id has more than one text."""
    digest = F.coalesce(F.xxhash64("_text"), F.lit(0))
    each = rows.filter("_id is not null").groupBy("_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    return not each.filter("lo <> hi").isEmpty()


def _row_components(df: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """jaccard_components() where no id has more than one text."""
    sets = written(_prefixes(df, id_col, text_col, percent, size))
    # prefixes are needed of one document of each set only, and none after the last pairs are found
    keys = written(sets.select("_id", "n", "key"))
    by_key = keys.filter("n > 0 and _id is not null").groupBy("key").agg(F.min("_id").alias("rep"))
    reps = sets.join(by_key.select(F.col("rep").alias("_id"), F.col("key").alias("key2")), "_id").filter("key = key2").dropDuplicates(["_id", "key"]).select("_id", "n", "p1", "p2", "p3")
    reps = written(reps)
    dropped(sets)
    texts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    tokens = reps.select("_id", "n", F.posexplode("p1").alias("i", "token")).select("token", F.struct("_id", "n", "i").alias("x"))
    shared = tokens.groupBy("token").agg(F.min("x").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = written(shared)
    members = written(tokens.join(shared, "token"))
    dropped(shared)
    # sizes must be close, and at the first token that two sets share enough tokens must be left in both
    close = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)")
    met = members.filter("x._id <> first._id").select(F.col("first._id").alias("a"), F.col("x._id").alias("b"), F.col("first.n").alias("na"), F.col("x.n").alias("nb"), F.col("first.i").alias("ia"), F.col("x.i").alias("ib"))
    met = written(met.filter(close).select("a", "b").distinct())
    links = _verified(met, reps, texts, percent, size)
    groups = written(components(links))

    # documents that share a token but no component yet, where the token has more than its first pair
    # components come to whole documents, not to each of their tokens
    held = members.filter("c > 2").groupBy("x._id").agg(F.collect_list(F.struct("token", "x.n", "x.i")).alias("held"))
    held = held.join(groups.withColumnRenamed("id", "_id"), "_id", "left")
    placed = written(held.select("_id", F.coalesce("component", "_id").alias("component"), F.inline("held")))
    dropped(members)
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    placed = written(placed.join(mixed, "token", "left_semi"))
    one, two = (placed.select("token", F.col("_id").alias(s), F.col("n").alias(f"n{s}"), F.col("i").alias(f"i{s}"), F.col("component").alias(f"c{s}")) for s in "ab")
    rest = one.join(two, (one.token == two.token) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close).select("a", "b").distinct()
    rest = rest.join(met, ["a", "b"], "left_anti")
    more = _verified(rest, reps, texts, percent, size)
    dropped(reps)
    groups = written(components(links.unionByName(more)))

    known = by_key.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("key").alias("key2"), F.coalesce("component", "rep").alias("_component"))
    out = keys.join(known, F.col("key") == F.col("key2"), "left")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, size: int = SHINGLE) -> DataFrame:
    """df with one row of each group of linked documents: that of the least id. Rows without words or without an id stay; columns stay.

    Rows that share an id with different texts are different documents: the least text hash decides between them. Rows that
    repeat id and text are copies: one of them stays.
    """
    texts = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.xxhash64(text_col)).alias("lo"), F.max(F.xxhash64(text_col)).alias("hi"), F.count(F.lit(1)).alias("n"))
    again = written(texts.filter("n > 1"))
    # the row travels as one column, so that no name of its columns can clash
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    if not again.filter("lo <> hi").isEmpty():
        rows = rows.withColumn("_id", F.when(F.col("_id").isNotNull(), F.struct("_id", F.xxhash64("_text").alias("text_hash"))))
    found = _row_components(rows, "_id", "_text", percent, size)
    lost = found.filter("n_shingles > 0 and component_id <> _id").select(F.col("_id").alias("_lost")).distinct()
    left = rows.join(lost, F.col("_id") == F.col("_lost"), "left_anti")
    if again.isEmpty():
        return left.select("_row.*")
    repeats = written(found.filter("n_shingles > 0 and _id is not null").groupBy(F.col("_id").alias("_again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_again"))
    single = left.join(repeats, F.col("_id") == F.col("_again"), "left_anti")
    once = left.join(repeats, F.col("_id") == F.col("_again"), "left_semi").dropDuplicates(["_id"])
    return single.unionByName(once).select("_row.*")
