"""Exact removal of long repeated passages with a logarithmic family of sparse suffix arrays.

Every window of `length` bytes holds at least one anchor: a place whose GRAM bytes have the least hash among
those of the window. Anchors depend on a window's bytes only, so equal windows have equal anchors, and the
suffixes that start at anchors stand for all others. A batch of documents gets its suffix array (anchors in the
order of their suffixes' first GRAM bytes), is merge-scanned against each level of the family for suffixes that
agree, and joins the family as a level; levels that hold equally many batches merge, so there are about log2 of
the number of batches.

Suffixes that agree in their first bytes are then ordered by all that matters of them, the bytes up to a window to either side,
and neighbours in that order and in the order of what precedes them give the longest matches to either side. A place is
removed if a match of `length` bytes or more covers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import dropped, row_map, small_batches, written

LENGTH, GRAM = 400, 32
BATCHES = 4
#: A gram with more contexts is not solved in one task: its windows are counted one by one.
MOST_CONTEXTS = 2000

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of width entries."""
    size, out = 1, x
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


#: Stretches with a period up to this are told from others; half a gram.
MOST_PERIOD = GRAM // 2
#: Bytes of a text that are looked at together.
BLOCK = 1 << 20
_HIGH = np.uint64(1 << 63)


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Places of data such that every window of length bytes holds one that depends on the window's bytes only; and stretches that repeat within themselves.

    A window's places are its grams of the least hash. Grams with a period up to MOST_PERIOD come after all others, so only windows that are
    periodic as a whole have none but these, and of them the first place counts. Of a stretch with such a period q and at least length + q
    bytes every byte lies in a window that comes again q bytes on, so it is reported whole, and only its first q windows, which
    are all the kinds it has, get places: a text of one character has a few, not one for each byte.
    """
    places, repeats = [np.empty(0, np.int64)], []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        found, runs = _anchors(np.frombuffer(data, np.uint8)[at : at + BLOCK + length - 1], length)
        places.append(found + at)
        repeats += [(lo + at, hi + at) for lo, hi in runs]
    return np.unique(np.concatenate(places)), repeats


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    h, size = _BYTE[data], 1
    while size < GRAM:
        if size == MOST_PERIOD:
            half = h
        h = h[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + h[size:]
        size *= 2
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1)
    n, width = len(h), length - GRAM + 1
    taken, repeats = np.ones(len(data) - length + 1, bool), []
    for q in range(1, MOST_PERIOD + 1):
        # half a gram comes again q bytes on; two such places make a gram of period q
        again = half[:-q] == half[q:]
        if not again.any():
            continue
        h[again[:n] & again[MOST_PERIOD - q : MOST_PERIOD - q + n]] |= _HIGH
        edges = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            end = hi + MOST_PERIOD + q - 1
            if end - lo >= length + q:
                repeats.append((lo, end))
                taken[lo + q : end - length + 1] = False
    least = _sliding(h, width, np.minimum)
    whole = np.flatnonzero((least >= _HIGH) & taken)
    least[~taken | (least >= _HIGH)] = 0
    # the greatest of the window minima around a place is its own hash iff it is a minimum of one of them
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    own = np.flatnonzero((_sliding(around, width, np.maximum) == h) & (h < _HIGH) & (h > 0))
    return np.concatenate([own, [x + int(h[x : x + width].argmin()) for x in whole]]).astype(np.int64), repeats


class IndexFamily:
    """Levels of suffix arrays; a level of rank r holds 2**r batches. Columns of arrays: gram, key, pos."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch's suffixes in; gives the grams of those that agree with another one of the batch or the family."""
        rank, array = 0, written(_ordered(batch))
        agree = array.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram")
        own = array.select("gram").distinct()
        for _, level in self.levels:
            agree = agree.unionByName(level.select("gram").join(own, "gram", "left_semi"))
        agree = written(agree.distinct())
        while self.levels and self.levels[-1][0] == rank:
            _, level = self.levels.pop()
            merged = written(_ordered(level.unionByName(array)))
            dropped(level)
            dropped(array)
            array, rank = merged, rank + 1
        self.levels.append((rank, array))
        return agree

    def suffixes(self) -> DataFrame:
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out


def _ordered(suffixes: DataFrame) -> DataFrame:
    """Suffixes dealt by gram and, in each part, in their order."""
    return suffixes.repartition("gram").sortWithinPartitions("gram", "key", "pos")


def _common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows of two byte tables, whose rows have la and lb bytes."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(la, lb))


def _table(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    return data, np.array([len(p) for p in parts], np.int64)


def longest(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of a gram, given what precedes it and what follows from it on: how far matches of length
    bytes or more with other occurrences reach to the left and to the right; zeros where there is none.

    lefts and rights are whole up to a window to each side. Equal contexts reach to their ends. Others look for
    partners from their neighbour on, in the order of one side, until one also matches far enough on the other;
    no farther one can match longer on the side that is ordered.
    """
    n = len(lefts)
    contexts: dict[tuple[bytes, bytes], list[int]] = {}
    for i, x in enumerate(zip(lefts, rights, strict=True)):
        contexts.setdefault(x, []).append(i)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    keys = list(contexts)
    c = len(keys)
    got_l, got_r = np.zeros(c, np.int64), np.zeros(c, np.int64)
    full = np.array([len(contexts[k]) > 1 and len(k[0]) + len(k[1]) >= length for k in keys])
    if c > 1:
        back, len_l = _table([k[0][::-1] for k in keys], max(1, max(len(k[0]) for k in keys)))
        ahead, len_r = _table([k[1] for k in keys], max(len(k[1]) for k in keys))
        order_l = np.array(sorted(range(c), key=lambda i: keys[i][0][::-1]))
        order_r = np.array(sorted(range(c), key=lambda i: keys[i][1]))

        def neighbours(order: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
            """Common lengths of consecutive rows in the order."""
            a, b = order[:-1], order[1:]
            return _common(data[a], data[b], size[a], size[b])

        step_l, step_r = neighbours(order_l, back, len_l), neighbours(order_r, ahead, len_r)

        def most(order: np.ndarray, step: np.ndarray) -> np.ndarray:
            out = np.zeros(c, np.int64)
            np.maximum.at(out, order[:-1], step)
            np.maximum.at(out, order[1:], step)
            return out

        most_l, most_r = most(order_l, step_l), most(order_r, step_r)

        def search(order: np.ndarray, step: np.ndarray, data: np.ndarray, size: np.ndarray, bound: np.ndarray) -> np.ndarray:
            """The longest match on the ordered side whose other side (data) makes it up to length."""
            out = np.zeros(c, np.int64)
            for way in (1, -1):
                at = np.flatnonzero(~full[order])  # places in the order that still look
                run = np.full(len(at), 1 << 30, np.int64)
                d = 0
                while len(at):
                    d += 1
                    ok = (at + way * d >= 0) & (at + way * d < c)
                    at, run = at[ok], run[ok]
                    run = np.minimum(run, step[at + (d - 1 if way > 0 else -d)])
                    me = order[at]
                    ok = (run + bound[me] >= length) & (run > out[me])
                    at, run, me = at[ok], run[ok], me[ok]
                    other = order[at + way * d]
                    hit = run + _common(data[me], data[other], size[me], size[other]) >= length
                    out[me[hit]] = run[hit]
                    at, run = at[~hit], run[~hit]
            return out

        if ((most_l + most_r >= length) & ~full).any():
            got_r = search(order_r, step_r, back, len_l, most_l)
            got_l = search(order_l, step_l, ahead, len_r, most_r)
    for i, k in enumerate(keys):
        rows = contexts[k]
        left[rows], right[rows] = (len(k[0]), len(k[1])) if full[i] else (got_l[i], got_r[i])
    return left, right


def _matches(contexts: DataFrame, length: int) -> DataFrame:
    """key, lo, hi: stretches of texts that matches of length bytes or more cover, from (gram, key, pos, l, r)."""
    small_batches(contexts.sparkSession)

    def solve(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        left, right = longest([x[2] for x in rows], [x[3] for x in rows], length)
        return [(x[0], x[1] - int(a), x[1] + int(b)) for x, a, b in zip(rows, left, right, strict=True) if b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rows, out = None, [], []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["key", "lo", "hi"])

        for batch in batches:
            for g, *x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if g != gram:
                    out += solve(rows)
                    gram, rows = g, []
                rows.append(tuple(x))
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        out += solve(rows)
        yield batch_of(out)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "key binary, lo long, hi long")


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same by counting: each window of length bytes around a place is a row, so a gram's places lie in no group of their own.

    Windows are known by a 128-bit hash and counted with partial sums; those that come again are joined to their places.
    """

    def one(x: dict) -> list[dict]:
        data, lo = bytes(x["l"]) + bytes(x["r"]), x["pos"] - len(x["l"])
        return [{"w": xxhash.xxh3_128_digest(data[i : i + length]), "lo": lo + i} for i in range(min(len(x["l"]), len(data) - length) + 1)]

    found = row_map(contexts, [F.col("key")], F.struct("pos", "l", "r"), lambda: one, "x array<struct<w:binary,lo:long>>")
    # several grams may lie in a window
    windows = written(found.select("key", F.explode("x").alias("x")).select("key", "x.w", "x.lo").distinct())
    again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w")
    return windows.join(again, "w").select("key", "lo", (F.col("lo") + length).alias("hi"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching stretches."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """id, _data binary, spans array<struct<lo,hi>>: for each row the stretches of its UTF-8 bytes that a string of length
    bytes covers which starts anywhere else too. Rows of equal texts are copies of each other. Null is empty.
    """
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    docs = df.select(F.col(id_col).alias("_id"), data.alias("_data")).withColumn("_key", F.unhex(F.md5("_data")))
    long = docs.filter(F.length("_data") >= length)
    found = row_map(long, [F.col("_id"), F.col("_key")], F.col("_data"), lambda: lambda x: (len(x), *_grams(x, length)), "n long, pos array<int>, grams array<binary>, own array<struct<lo:long,hi:long>>")
    found = written(found)
    copies = written(found.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("own").alias("own")))

    index, agree = IndexFamily(), None
    each = found.dropDuplicates(["_key"]).select(F.col("_key").alias("key"), F.explode(F.arrays_zip("pos", "grams")).alias("x")).select(F.col("x.grams").alias("gram"), "key", F.col("x.pos").alias("pos"))
    each = each.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(batches)))
    suffixes = written(each)
    for b in range(batches):
        grams = index.add(suffixes.filter(F.col("part") == b).drop("part"))
        agree = grams if agree is None else agree.unionByName(grams)
    dropped(suffixes)
    places = index.suffixes().join(agree.distinct(), "gram", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    places = written(places.join(copies.select(F.col("_key").alias("key"), "rep"), "key"))

    one = long.join(places, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("rep")))
    contexts = row_map(one, [F.col("_key").alias("key")], F.struct("_data", "places"), lambda: lambda x: [_context(x["_data"], p, length) for p in x["places"]], "c array<struct<gram:binary,pos:long,l:binary,r:binary>>")
    contexts = contexts.select("key", F.explode("c").alias("c")).select("c.gram", "key", "c.pos", "c.l", "c.r")
    contexts = written(contexts)
    hot = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > MOST_CONTEXTS).select("gram"))
    if hot.isEmpty():
        matches = _matches(contexts, length)
    else:
        matches = _matches(contexts.join(hot, "gram", "left_anti"), length).unionByName(_windows(contexts.join(hot, "gram", "left_semi"), length))
    spans = matches.distinct().groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("some"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    verdict = copies.join(spans, F.col("_key") == F.col("key"), "left").filter("copies > 1 or key is not null or size(own) > 0")
    every = F.concat(F.coalesce("some", F.array().cast("array<struct<lo:long,hi:long>>")), "own")
    verdict = written(verdict.select(F.col("_key").alias("key"), F.when(F.col("copies") > 1, whole).otherwise(every).alias("spans")))
    return docs.join(verdict, F.col("_key") == F.col("key"), "left").select(F.col("_id").alias(id_col), "_data", "spans")


def _grams(data: bytes, length: int) -> tuple[list[int], list[bytes], list[dict]]:
    places, repeats = anchors(data, length)
    return places.tolist(), [data[p : p + GRAM] for p in places.tolist()], [{"lo": lo, "hi": hi} for lo, hi in repeats]


def _context(data: bytes, p: int, length: int) -> dict:
    return {"gram": data[p : p + GRAM], "pos": p, "l": data[max(0, p - length + GRAM) : p], "r": data[p : p + length]}


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_removed, n_spans, kept binary: the bytes outside repeated stretches.

    A stretch is judged on the input: of copies no occurrence stays. Nulls are empty texts; texts shorter than
    length keep all; ids may be null or repeat; rows that repeat are copies of each other. Other columns are not read.
    """

    def one(x: dict) -> tuple:
        data, kept, at = bytes(x["_data"]), [], 0
        spans = united([(s["lo"], s["hi"]) for s in x["spans"] or ()])
        for lo, hi in spans:
            kept.append(data[at:lo])
            at = hi
        kept.append(data[at:])
        return len(data), sum(hi - lo for lo, hi in spans), len(spans), b"".join(kept)

    found = repeated_spans(df, id_col, text_col, length, batches)
    return row_map(found, [F.col(id_col)], F.struct("_data", "spans"), lambda: one, "n_bytes long, n_removed long, n_spans long, kept binary")


