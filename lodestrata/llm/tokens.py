"""Token counts of texts: each distinct pre-token is cut into pieces once, and a text's count is a sum over its pre-tokens.

A tokenizer's model works on pre-tokens one by one, so a text has as many tokens as its pre-tokens have together. One pass counts the
corpus's pre-tokens (with partial sums) and the model counts the pieces of each distinct one. A second pass makes every text's
pre-token frequencies and joins them: those of frequent pre-tokens, a table of bounded entries and bytes that every task
gets, where the text is read, the others by an equi-join. No ids are made for any text.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestrata.llm.common import written

#: Bounds of the table that every task gets.
KNOWN_TOKENS, KNOWN_BYTES = 1 << 19, 16 << 20
#: Distinct pre-tokens that a task counts before it passes them on.
HELD_TOKENS = 400_000
#: Bytes of one pre-token count for so much more in Python and Arrow.
_ROW_BYTES = 16


def _byte_signs() -> dict[int, int]:
    """The characters that byte-level vocabularies write for bytes: visible ones of Latin-1 for themselves, others from U+0100 on."""
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    return dict(zip([c for c in range(256) if c not in own], range(256, 512)))


_BYTE_SIGNS = _byte_signs()


@functools.cache
def _classes() -> tuple[str, str, str, re.Pattern]:
    """Character classes of letters, numbers and spaces among the assigned characters up to U+FFFF, and a pattern of all others."""
    kinds: dict[str, list[list[int]]] = {"L": [], "N": [], "Z": [], "": []}
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        kind = "Z" if kind[0] == "Z" or 9 <= c <= 13 or c == 0x85 else kind[0] if kind[0] in "LN" else "" if kind in ("Cn", "Cs", "Co") else None
        if kind is not None:
            ranges = kinds[kind]
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    letters, numbers, spaces, odd = ("".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in kinds[k]) for k in ("L", "N", "Z", ""))
    return letters, numbers, spaces, re.compile(f"[{odd}\U00010000-\U0010ffff]")


class PreTokens:
    """Pre-tokens of texts, and how many tokens the model makes of each, for a file of the tokenizers library."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(model)
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        #: Strings that are one token each wherever they stand; texts are cut there first.
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = frozenset(names)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        first = spec.get("pre_tokenizer") or {}
        #: Byte-level pre-tokens are stretches of the text; others are what the library makes of it.
        self.plain = spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        if self.plain:
            letters, numbers, spaces, self.odd = _classes()
            # the pattern of byte-level vocabularies, with its classes spelled out
            self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")

    def _part(self, text: str) -> list[str]:
        if self.plain and not self.odd.search(text):
            return self.pattern.findall(text)
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        text = normal.normalize_str(text) if normal else text
        if split is None:
            return [text] if text else []
        found = split.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found] if self.plain else [x for x, _ in found]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a whole text, and special strings as they stand."""
        if self.cut is None or not any(name in text for name in self.special):
            return self._part(text)
        out: list[str] = []
        for x in self.cut.split(text):
            out += [x] if x in self.special else self._part(x)
        return out

    def pieces(self, tokens: Sequence[str]) -> list[int]:
        """How many tokens each pre-token or special string is."""
        cut, special = self.library.model.tokenize, self.special
        if self.plain:
            tokens = [x if x in special else x.encode().decode("latin-1").translate(_BYTE_SIGNS) for x in tokens]
        return [1 if x in special else len(cut(x)) for x in tokens]


_READY: dict[int, PreTokens] = {}


def _ready(model: str) -> PreTokens:
    """One for each model and Python worker."""
    key = hash(model)
    if key not in _READY:
        _READY[key] = PreTokens(model)
    return _READY[key]


def load_model(path: str) -> str:
    """A tokenizers file, read where the driver runs and sent along with the functions."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _batch(rows: list[tuple], shape: StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in shape]
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, shape, strict=True)], names=shape.names)


def pretoken_pieces(texts: DataFrame, model: str) -> DataFrame:
    """token, n (occurrences), pieces for every distinct pre-token of the one column of texts; null is empty. Written down."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    counts, shape = StructType.fromDDL("token string, n long"), StructType.fromDDL("token string, n long, pieces int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, held, size = _ready(sent.value), Counter(), 0

        def full() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            held.clear()
            for at in range(0, len(rows), 20_000):
                yield _batch(rows[at : at + 20_000], counts)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(pre.split(text))
                    size += len(text)
                if len(held) >= HELD_TOKENS or size >= 1 << 28:
                    yield from full()
                    size = 0
        yield from full()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = _ready(sent.value)
        for batch in batches:
            pieces = pa.array(pre.pieces(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], names=shape.names)

    distinct = texts.mapInArrow(count, counts).groupBy("token").agg(F.sum("n").alias("n"))
    return written(distinct.mapInArrow(cut, shape))


def _frequent(tokens: DataFrame) -> tuple[int, dict[str, int]]:
    """A number of occurrences, and the pieces of the pre-tokens with more, which are within KNOWN_TOKENS and KNOWN_BYTES."""
    size = F.octet_length("token") + _ROW_BYTES
    step = F.floor(F.log2("n")).cast("int")
    least = 63
    entries = volume = 0
    for row in sorted(tokens.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("volume")).collect(), reverse=True):
        entries, volume = entries + row["entries"], volume + row["volume"]
        if entries > KNOWN_TOKENS or volume > KNOWN_BYTES:
            break
        least = row["step"]
    chosen = tokens.filter(step >= least).select("token", "pieces").toArrow()
    return least, dict(zip(chosen.column(0).to_pylist(), chosen.column(1).to_pylist(), strict=True))


def token_counts(df: DataFrame, keep: Sequence[Column], text: Column, model: str, out_col: str = "n_tokens") -> DataFrame:
    """The columns `keep` and a long column of how many tokens the library makes of each text.

    One row for each row of df, in no order. Begin, end and other added tokens don't count; special strings in a text are one token each,
    as is the library's default. Null and empty texts have 0. Whole texts are counted, nothing is cut off. Columns of keep may have any names.
    """
    spark: SparkSession = df.sparkSession
    tokens = pretoken_pieces(df.select(text.alias("text")), model)
    least, known = _frequent(tokens)
    sent, table = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(known)
    kept = F.struct(*keep)
    given = df.select(kept.alias("kept"), text.alias("text")).withColumn("row", F.monotonically_increasing_id()).select("kept", "row", "text")
    shape = StructType([*given.schema.fields[:2], *StructType.fromDDL("known long, rest array<struct<token:string,n:long>>").fields])
    kinds = [to_arrow_type(f.dataType) for f in shape.fields[2:]]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, pieces = _ready(sent.value), table.value
        for batch in batches:
            knowns, rests = [], []
            for text in batch.column(2).to_pylist():
                total, rest = 0, []
                for token, n in Counter(pre.split(text or "")).items():
                    if (each := pieces.get(token)) is None:
                        rest.append({"token": token, "n": n})
                    else:
                        total += n * each
                knowns.append(total)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(knowns, kinds[0]), pa.array(rests, kinds[1])], names=shape.names)

    rows = written(given.mapInArrow(sums, shape))
    rare = tokens.filter(F.floor(F.log2("n")).cast("int") < least).select("token", "pieces")
    more = rows.select("row", F.inline("rest")).join(rare, "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    found = rows.select("row", "kept", "known").join(more, "row", "left")
    return found.select("kept.*", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias(out_col))
