"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's bytes, lower-cased and with other ASCII than letters as spaces, give subwords of ORDERS bytes, each hashed to one
of BUCKETS embeddings. The mean of a text's embeddings goes through a linear layer and a softmax. Embeddings and
layer are trained together by stochastic gradient descent in numpy. A temperature and a rejection threshold
are calibrated on labelled documents that the training didn't see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import row_map

ORDERS = (2, 3, 4)
BUCKETS, WIDTH = 1 << 13, 16
#: Labelled documents that training takes at most, those with the smallest hashes of their ids; a bound on the driver's
#: memory, not on what is predicted.
SAMPLE_DOCS = 2000
#: Bytes of a training example: sampled documents are cut into pieces, so that short texts are seen too.
PIECE = 400
EPOCHS, RATE = 4, 0.5
CALIBRATION = 5  # every fifth sampled document calibrates
MOST_WRONG = 0.01
#: Bytes of a text that are in arrays at a time.
STRETCH = 1 << 20

_TABLE = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" "


def subwords(data: bytes) -> np.ndarray:
    """Buckets of all subwords of prepared bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, h = [], b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(16777619) + b[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761 + 2 * n)
            out.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times layer, as a mean and a linear map commute
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        data, total, count = prepared(text), np.zeros(len(self.languages)), 0
        overlap = max(ORDERS) - 1
        for at in range(0, max(1, len(data) - overlap), STRETCH):
            ids = subwords(data[at : at + STRETCH + overlap])
            if at + STRETCH + overlap < len(data):  # subwords that start in the overlap belong to the next stretch
                ids = np.concatenate([subwords_of(data[at : at + STRETCH + n - 1], n) for n in ORDERS])
            total += self.table[ids].sum(axis=0)
            count += len(ids)
        return total / max(1, count) + self.bias

    def chances(self, text: str) -> np.ndarray:
        z = self.logits(text) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its chance, and whether that is under the threshold; `und`, 0, True without letters."""
        if not has_letter(text):
            return "und", 0.0, True
        p = self.chances(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def subwords_of(data: bytes, n: int) -> np.ndarray:
    """Buckets of the subwords of one order."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < n:
        return np.empty(0, np.uint32)
    h = b
    for k in range(2, n + 1):
        h = h[:-1] * np.uint32(16777619) + b[k - 1 :]
    return ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761 + 2 * n)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def train(rows: list[tuple[str, str]], seed: int = 5) -> LanguageModel:
    """A model from (text, language) rows, the same for the same rows. Rows that calibrate aren't trained on."""
    rows = [(t, l) for t, l in rows if has_letter(t)]
    languages = sorted({l for _, l in rows})
    if not languages:
        return LanguageModel(["und"], np.zeros((BUCKETS, 1)), np.zeros(1))
    index = {l: i for i, l in enumerate(languages)}
    learn = [r for i, r in enumerate(rows) if i % CALIBRATION or len(rows) < 2 * CALIBRATION]
    check = [r for i, r in enumerate(rows) if not (i % CALIBRATION or len(rows) < 2 * CALIBRATION)]
    examples = []
    for text, language in learn:
        data = prepared(text)
        for at in range(0, len(data), PIECE):
            ids, counts = np.unique(subwords(data[at : at + PIECE]), return_counts=True)
            if len(ids):
                examples.append((ids, (counts / counts.sum()).astype(np.float64), index[language]))
    share = np.bincount([y for _, _, y in examples], minlength=len(languages))
    weight = len(examples) / (len(languages) * np.maximum(share, 1))  # languages count alike
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1.0 / WIDTH, 1.0 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            ids, x, y = examples[i]
            rate = RATE * (1 - done / steps) * min(weight[y], 4.0)
            done += 1
            mean = x @ emb[ids]
            z = mean @ layer + bias
            z = np.exp(z - z.max())
            grad = z / z.sum()
            grad[y] -= 1
            back = layer @ grad
            layer -= rate * np.outer(mean, grad)
            bias -= rate * 0.1 * grad
            emb[ids] -= rate * 20.0 * x[:, None] * back
    model = LanguageModel(languages, np.round(emb @ layer, 6), np.round(bias, 6))
    if check:
        _calibrate(model, check, index)
    return model


def _calibrate(model: LanguageModel, check: list[tuple[str, str]], index: dict[str, int]) -> None:
    """The temperature with the least log loss, then the least threshold above which at most MOST_WRONG are wrong."""
    z, y = np.array([model.logits(t) for t, _ in check]), np.array([index[l] for _, l in check])

    def chances(t: float) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    steps = [2.0 ** (k / 2) for k in range(-6, 9)]
    model.temperature = min(steps, key=lambda t: (-np.log(np.maximum(chances(t)[np.arange(len(y)), y], 1e-12)).mean(), t))
    p = chances(model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= MOST_WRONG)
    last = int(fine[-1]) if len(fine) else -1
    model.threshold = 1.0 if last < 0 else 0.0 if last == len(y) - 1 else float(top[order[last]])


def sampled_rows(df: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most so many labelled rows for training, in the order of their ids' hashes. Their ids are chosen first, so texts of others don't move."""
    given = df.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    hashed = F.xxhash64(F.lit(17), id_col)
    chosen = given.select(F.col(id_col).alias("_chosen")).distinct().orderBy(F.xxhash64(F.lit(17), "_chosen"), "_chosen").limit(most)
    rows = given.join(F.broadcast(chosen), F.col(id_col) == F.col("_chosen"), "left_semi").select(hashed.alias("h"), F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    return [(r.t, r.l) for r in sorted(rows.collect(), key=lambda r: (r.h, str(r.i), r.t, r.l))[:most]]


def identify_language(df: DataFrame, model: LanguageModel, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns keep, and lang_pred, score, rejected for each row: whole texts, one row out for each row in.

    Null texts and texts without a letter are `und` with score 0 and rejected.
    """
    return row_map(df, keep, F.col(text_col), lambda: model.predict, "lang_pred string, score double, rejected boolean")
