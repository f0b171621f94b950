"""Phrase collocations: n-gram counts from suffix arrays of word ids, scored against the parts that each phrase can be cut into.

A task gathers the texts of a language into shards of so many words. A shard is a sequence of word ids with breaks (id 0) between
pieces of text; prefix doubling in numpy orders its suffixes by their first words, and in that order the suffixes that share n words are an
interval of their LCP array, whose length is the n-gram's count in the shard. Counts of all shards meet by their key.

No part of a phrase is rarer than the phrase, so the words are counted first, then pairs of frequent words, then longer phrases whose
pairs all are frequent. Tasks know the frequent ones by a bitmap of fixed size; what it takes for frequent by chance is counted for
nothing, and no phrase is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import dropped, written

MOST_WORDS = 4
LEAST_COUNT = 30
SUBSUMED_PERCENT = 80
TOP = 2000
#: Words of a shard, and characters of its texts.
SHARD_WORDS, SHARD_CHARS = 1 << 19, 1 << 28
#: Rows of a batch that a task returns, and bytes of their words.
BATCH_ROWS, BATCH_BYTES = 50_000, 1 << 26
#: Bits of the map of frequent words or pairs that every task gets (8 MB), and of one of its blocks.
FILTER_BITS, BLOCK_BITS = 1 << 26, 1 << 16

#: A language's phrases are ranked in so many parts first.
_PARTS = 32
#: The row of this phrase counts all words of a language.
_ALL = ""

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAK = b"\xff"  # no UTF-8 text has this byte
_SIGNS = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Ids(dict):
    """Ids by the order of first occurrence; a break has 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words, and a break for each sign that ends a piece."""
    return text.encode().translate(_SIGNS).replace(_BREAK, b" \xff ").split()


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ids that aren't breaks, ordered by the up to depth words from there on, and how many words follow from each place up to a break.

    Prefix doubling: ranks by the first 1, 2, 4, ... words; it ends once these are depth words or all ranks differ.
    """
    n = len(ids)
    ends = np.append(np.flatnonzero(ids == 0), n)
    reach = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    at = np.flatnonzero(reach)
    rank, width = ids.astype(np.int64), 1
    if depth == 1:
        return at[np.argsort(rank[at], kind="stable")], reach
    while True:
        later = np.zeros(n, np.int64)
        later[: max(0, n - width)] = rank[width:]
        later[reach <= width] = 0
        key = rank[at] * (rank.max(initial=0) + 1) + later[at]
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        rank[at[order]] = new
        width *= 2
        if width >= depth or (len(new) and new[-1] == len(at)) or not len(at):
            return at[order], reach


def ngram_counts(ids: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n from least to most: n, a place of each distinct n-gram, and its count. N-grams don't reach over breaks."""
    order, reach = suffix_array(ids, most)
    if not len(order):
        return
    a, b = order[:-1], order[1:]
    same, lcp = np.ones(len(a), bool), np.zeros(len(a), np.int64)
    padded = np.append(ids, np.zeros(most, ids.dtype))
    for t in range(most):
        same &= (reach[a] > t) & (reach[b] > t) & (padded[a + t] == padded[b + t])
        lcp += same
    for n in range(least, most + 1):
        # an interval begins wherever fewer than n words are shared with the suffix before
        begins = np.flatnonzero(np.concatenate([[True], lcp < n]))
        sizes = np.diff(np.append(begins, len(order)))
        whole = reach[order[begins]] >= n
        yield n, order[begins[whole]], sizes[whole]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * _STEP + second)


class _Map:
    """Whether a hash may be of a frequent word or pair."""

    def __init__(self, bits: int, blocks: list[tuple[int, bytes]]):
        self.bits = np.uint64(bits)
        self.data = np.zeros(bits // 8, np.uint8)
        for block, data in blocks:
            self.data[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = np.frombuffer(data, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes % self.bits).astype(np.int64)
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _map_of(grams: DataFrame, bits: int) -> _Map:
    """The map of the phrases (lang, phrase) of one or two words. Blocks of it are made in tasks and united by their number."""

    def blocks_of(hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        place = np.unique((hashes % np.uint64(bits)).astype(np.int64))
        block = place // BLOCK_BITS
        for own in np.split(place, np.flatnonzero(np.diff(block)) + 1) if len(place) else []:
            marks = np.zeros(BLOCK_BITS, np.uint8)
            marks[own % BLOCK_BITS] = 1
            yield int(own[0] // BLOCK_BITS), np.packbits(marks, bitorder="little").tobytes()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _word_hashes(lang, phrase.encode().split(b" "))
                hashes.append(own[:1] if len(own) == 1 else _pair_hashes(own[:1], own[1:]))
            rows = list(blocks_of(np.concatenate(hashes))) if hashes else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])

    def unite(table: pa.Table) -> pa.Table:
        data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("data").to_pylist()])
        return pa.table({"block": table.column("block")[:1], "data": pa.array([data.tobytes()], pa.binary())})

    marked = grams.select("lang", "phrase").mapInArrow(mark, "block int, data binary")
    return _Map(bits, [(r["block"], bytes(r["data"])) for r in marked.groupBy("block").applyInArrow(unite, "block int, data binary").collect()])


def _chained(ids: np.ndarray, linked: np.ndarray, least: int) -> np.ndarray:
    """The stretches of at least so many words of which each is linked with the next (linked[i]: words i and i + 1), with a break after each."""
    n = len(ids)
    if not n:
        return ids
    stretch = np.cumsum(np.concatenate([[False], ~linked]))
    keep = (np.bincount(stretch)[stretch] >= least) & (ids > 0)
    kept, of = ids[keep], stretch[keep]
    new = np.cumsum(np.concatenate([[False], np.diff(of) != 0])) if len(of) else of
    out = np.zeros(len(kept) + (int(new[-1]) + 1 if len(of) else 0), ids.dtype)
    out[np.arange(len(kept)) + new] = kept
    return out


def _counts(texts: DataFrame, least: int, most: int, words: _Map | None = None, pairs: _Map | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, words int, n long: counts of the n-grams of least to most words over all texts (lang, text).

    With maps only n-grams of words, and of pairs, that they hold. For single words there is also the row of all words of a language.
    """
    sc = texts.sparkSession.sparkContext
    sent = sc.broadcast((words, pairs))

    def grams(lang: str, ids: _Ids, places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        frequent, linked = sent.value
        own, seq = [b"", *list(ids)[1:]], np.concatenate([*places, np.zeros(1, np.int32)])
        text, length = pa.array(own, pa.binary()).cast(pa.string()), np.fromiter(map(len, own), np.int64)
        if least == 1:
            yield batch_of(lang, pa.array([_ALL]), 0, np.array([(seq > 0).sum()]))
        if frequent is not None or linked is not None:
            hashes = _word_hashes(lang, own)
            if frequent is not None:
                ok = frequent.holds(hashes)
                ok[0] = False
                seq = np.where(ok[seq], seq, 0)
            link = (seq[:-1] > 0) & (seq[1:] > 0)
            if linked is not None:
                at = np.flatnonzero(link)
                link[at] = linked.holds(_pair_hashes(hashes[seq[at]], hashes[seq[at + 1]]))
            seq = _chained(seq, link, least)
        for n, at, count in ngram_counts(seq, least, most):
            size = np.cumsum(sum(length[seq[at + t]] for t in range(n)))
            full = np.searchsorted(size, np.arange(BATCH_BYTES, int(size[-1]) if len(size) else 0, BATCH_BYTES))
            edges = np.unique(np.concatenate([np.arange(0, len(at), BATCH_ROWS), full, [len(at)]]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                words = [text.take(pa.array(seq[at[lo:hi] + t])) for t in range(n)]
                yield batch_of(lang, pc.binary_join_element_wise(*words, " ") if n > 1 else words[0], n, count[lo:hi])

    def batch_of(lang: str, phrases: pa.Array, n: int, count: np.ndarray) -> pa.RecordBatch:
        size = len(phrases)
        columns = [pa.repeat(lang, size), phrases, pa.array(np.full(size, n), pa.int32()), pa.array(count, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        size = chars = 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, places = shards.get(lang) or shards.setdefault(lang, (_Ids({_BREAK: 0}), []))
                found = np.fromiter(map(ids.__getitem__, _tokens(text)), np.int32)
                places += [found, np.zeros(1, np.int32)]
                size, chars = size + len(found) + 1, chars + len(text)
                if size >= shard_words or chars >= SHARD_CHARS:
                    for one in list(shards):
                        yield from grams(one, *shards.pop(one))
                    size = chars = 0
        for one in list(shards):
            yield from grams(one, *shards.pop(one))

    return texts.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def frequent_phrases(df: DataFrame, text: Column, lang: Column, least_count: int = LEAST_COUNT, filter_bits: int = FILTER_BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, words int, n: every phrase of 1 to 4 words that occurs at least least_count times in the texts of its language, and for
    each language a row of 0 words and an empty phrase with the number of all words. Written down.
    """
    texts = df.select(F.coalesce(lang, F.lit("und")).alias("lang"), text.alias("text")).filter(F.col("text").isNotNull())
    enough = F.col("n") >= least_count
    one = written(_counts(texts, 1, 1, shard_words=shard_words).filter(enough | (F.col("words") == 0)))
    words = _map_of(one.filter("words = 1"), filter_bits)
    two = written(_counts(texts, 2, 2, words, shard_words=shard_words).filter(enough))
    pairs = _map_of(two, filter_bits)
    more = written(_counts(texts, 3, MOST_WORDS, words, pairs, shard_words=shard_words).filter(enough))
    return one.unionByName(two).unionByName(more)


def collocations(df: DataFrame, text: Column, lang: Column, least_count: int = LEAST_COUNT, subsumed_percent: int = SUBSUMED_PERCENT, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (all numbers long): each language's best phrases of 2 to 4 words.

    A phrase with a occurrences, cut into parts with l and r, scores floor(2,000,000 a / (l + r)); its lowest cut counts, of equal
    ones the one with the shortest first part. A phrase goes if a longer one of at least least_count occurrences holds its words and has
    at least subsumed_percent of its occurrences. Order: score and a descending, phrase by its UTF-8 bytes.

    Texts are whole; A-Z are lower-cased; a null language is `und`; null and empty texts have no words; repeated rows count
    each. Arithmetic is in decimals of 38 digits. A table without phrases gives no rows.
    """
    grams = written(frequent_phrases(df, text, lang, least_count, **sizes))
    phrases = grams.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    counts = grams.filter("words between 1 and 3")
    exact = "decimal(38,0)"

    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - words)")})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    parts = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(parts, at, size), " "))))
    longer = phrases.filter("words >= 3").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.lit(100).cast(exact) * F.col("longer").cast("decimal(20,0)") >= F.lit(subsumed_percent).cast(exact) * F.col("a").cast("decimal(20,0)")
    left = best.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(held, F.lit(False)))

    rows = left.select("lang", "phrase", "a", "best.l", "best.r", F.col("best.score").cast("long").alias("score"))
    order = "order by score desc, a desc, phrase"
    for part in (f"lang, pmod(xxhash64(phrase), {_PARTS})", "lang"):
        rows = rows.withColumn("rank", F.expr(f"row_number() over (partition by {part} {order})").cast("long")).filter(F.col("rank") <= top)
    words = grams.filter("words = 0").select("lang", "n")
    return rows.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
