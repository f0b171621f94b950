"""SentencePiece models: pieces by a single-pass Viterbi over an Aho-Corasick automaton, and texts back from pieces.

The automaton holds every piece of the model. One pass over a text yields, at each position, all pieces that end
there (the automaton's output links); each relaxes the best score at its end from the best score at its
start. Characters that are no piece by themselves may become byte pieces. The best path is the one with the largest sum of
scores; of equal ones, the one whose last piece is longer.

Where no piece reaches across a place (before a run of word marks, and around a character that no piece holds), a
text's best path is the best paths of its parts, so parts are solved once and kept in a bounded table.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import small_batches

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts of texts whose pieces a worker keeps.
KEPT_PARTS = 300_000
#: Parts longer than this aren't kept.
KEPT_CHARS = 64
#: The score of a character in bytes is this much under the lowest score of a piece.
PENALTY = 10

_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
#: Scores under this mark pieces that no path should take while another exists.
_BANNED = -1e8


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if wire == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a SentencePiece model file with no text normalisation."""
    pieces, name = [], "identity"
    for field, value in _fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, _NORMAL
            for f, v in _fields(value):
                if f == 1:
                    piece = v.decode()
                elif f == 2:
                    (score,) = struct.unpack("<f", v)
                elif f == 3:
                    kind = v
            pieces.append((piece, score, kind))
        elif field == 3:
            for f, v in _fields(value):
                if f == 1:
                    name = v.decode()
    if name != "identity":
        raise ValueError(f"texts would be normalised by {name}; only models without normalisation round-trip")
    return pieces


class _Kept(dict):
    """The pieces of parts; those that aren't kept are solved when asked for, and of them short ones are kept."""

    def __init__(self, solve: Callable[[str], tuple[int, ...]]):
        self.solve = solve

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.solve(part)
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT_PARTS:
                self.clear()
            self[part] = ids
        return ids


class Pieces:
    """Encodes and decodes texts. Needs a model with byte pieces, so that every text comes back unchanged."""

    def __init__(self, model: bytes):
        table = read_model(model)
        self.text = [p for p, _, _ in table]
        self.sizes = [len(p) for p in self.text]
        self.byte_of = {i: int(p[3:5], 16) for i, (p, _, k) in enumerate(table) if k == _BYTE}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        if len(self.id_of_byte) != 256:
            raise ValueError("the model has no byte pieces")
        usable = [(p, s, i) for i, (p, s, k) in enumerate(table) if k in (_NORMAL, _USER) and p]
        self.byte_score = min((s for _, s, _ in usable if s > _BANNED), default=0.0) - PENALTY
        #: Characters that are pieces by themselves, so that every place after them can be reached without bytes.
        self.covered = frozenset(p for p, _, _ in usable if len(p) == 1)
        self.automaton = self._automaton(usable)
        # a piece that its own parts outscore is on no best path, so it needn't be found
        self.automaton = self._automaton([x for x in usable if self.viterbi(x[0]) == (x[2],)])
        held = {c for p, _, _ in usable for c in p}
        #: Cuts marked text at places that no piece of this model reaches across; None if there may be none.
        self.split = None
        if not any(MARK in p.lstrip(MARK) for p, _, _ in usable):
            cut = "" if "\n" in held else "\n"
            self.split = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}" if cut else ""))
        self.kept = _Kept(self.viterbi)
        #: What an id stands for in a text; a byte above 127 is no character by itself.
        self.plain = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p.replace(MARK, " ") for i, p in enumerate(self.text)]
        self.high = np.array([i in self.byte_of and self.byte_of[i] > 127 for i in range(len(self.text))])

    @staticmethod
    def _automaton(pieces: list[tuple[str, float, int]]) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for p, s, i in pieces:
            automaton.add_word(p, (len(p), s, i))
        automaton.make_automaton()
        return automaton

    def viterbi(self, part: str) -> tuple[int, ...]:
        """The best path over a stretch of text."""
        # by a stretch's last character; the place before the first one stands at the end, where index -1 finds it
        best = [float("-inf")] * len(part)
        best.append(0.0)
        back = [-1] * len(part)  # the last piece's id; -1 stands for the bytes of a character
        done, byte_score, covered, sizes = 0, self.byte_score, self.covered, self.sizes

        def bytes_until(place: int) -> None:
            nonlocal done
            for at in range(done, place):
                if part[at] not in covered:
                    score = best[at - 1] + byte_score
                    if score > best[at]:
                        best[at], back[at] = score, -1
            done = place

        # links go from longer pieces to shorter ones: the first of equal scores is the longest
        if covered.issuperset(part):  # pieces reach every place and bytes aren't needed
            for end, (size, score, piece) in self.automaton.iter(part):
                score += best[end - size]
                if score > best[end]:
                    best[end] = score
                    back[end] = piece
        else:
            for end, (size, score, piece) in self.automaton.iter(part):
                if done < end:
                    bytes_until(end)
                score += best[end - size]
                if score > best[end]:
                    best[end] = score
                    back[end] = piece
            bytes_until(len(part))
        out: list[int] = []
        at = len(part) - 1
        while at >= 0:
            piece = back[at]
            if piece < 0:
                out.extend(self.id_of_byte[b] for b in reversed(part[at].encode()))
                at -= 1
            else:
                out.append(piece)
                at -= sizes[piece]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. A word mark that is itself in the text becomes byte pieces, so that it comes back."""
        out: list[int] = []
        for i, stretch in enumerate(text.split(MARK)):
            if i:
                out.extend(self.id_of_byte[b] for b in MARK.encode())
            marked = ("" if i else MARK) + stretch.replace(" ", MARK)
            if self.split is None:
                out.extend(self.viterbi(marked))
                continue
            out.extend(chain.from_iterable(map(self.kept.__getitem__, self.split.findall(marked))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids that encode() gives."""
        if not len(ids):
            return ""
        if not self.high[ids].any():
            return "".join(map(self.plain.__getitem__, ids))[1:]
        out: list[str] = []
        pending = bytearray()
        text, byte_of = self.text, self.byte_of
        for i in ids:
            if i in byte_of:
                pending.append(byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(text[i].replace(MARK, " "))
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)[1:]


_READY: dict[int, Pieces] = {}


def _ready(model: bytes) -> Pieces:
    """One automaton for each model and Python worker."""
    key = hash(model)
    if key not in _READY:
        _READY[key] = Pieces(model)
    return _READY[key]


@contextmanager
def _uncollected():
    """Holds off the search for cycles: none are made here, and it would go through all parts that are kept again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def load_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read where the driver runs and sent along with the functions (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encoder(spark: SparkSession, model: bytes):
    """Column to column: a text to an array of piece ids; null to null, an empty text to one word mark."""
    small_batches(spark)

    @F.arrow_udf("array<int>")
    def encode_pieces(texts: pa.Array) -> pa.Array:
        pieces, rows = _ready(model), texts.to_pylist()
        # texts that a batch holds again are encoded once
        with _uncollected():
            done = {t: None if t is None else pieces.encode(t) for t in dict.fromkeys(rows)}
        return pa.array([done[t] for t in rows], pa.list_(pa.int32()))

    return encode_pieces


def decoder(spark: SparkSession, model: bytes):
    """Column to column: an array of piece ids to a text; null to null."""
    small_batches(spark)

    @F.arrow_udf("string")
    def decode_pieces(ids: pa.Array) -> pa.Array:
        pieces = _ready(model)
        edges, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False).tolist()
        with _uncollected():
            texts = [pieces.decode(flat[lo:hi]) if ok else None for lo, hi, ok in zip(edges, edges[1:], ids.is_valid().to_pylist())]
        return pa.array(texts, pa.string())

    return decode_pieces


def encode_pieces(df: DataFrame, model: bytes, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """df with a column of piece ids; a column of that name is replaced."""
    return df.withColumn(out_col, encoder(df.sparkSession, model)(F.col(text_col)))


def decode_pieces(df: DataFrame, model: bytes, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """df with a column of the texts that the ids stand for; a column of that name is replaced."""
    return df.withColumn(out_col, decoder(df.sparkSession, model)(F.col(ids_col)))


def byte_pieces(ids: Column, model: bytes) -> Column:
    """How many of the ids are byte pieces; ids of bytes are consecutive in every model file."""
    own = sorted(i for i, (_, _, k) in enumerate(read_model(model)) if k == _BYTE)
    return F.size(F.filter(ids, lambda x: x.between(own[0], own[-1])))
