"""Periodic runs, token counts and phrases, against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import phrases, queries, runs, tokens
from tests.llm import brute
from tests.llm.test_operators import ROWS, docs_of, edge, edge_rows, empty, of  # noqa: F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["tiny", "edge"])
def data(request):
    return request.getfixturevalue(request.param)


def made_words(doc_id, text):
    """The words that op11 looks at."""
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_query(spark, data):
    got = of(queries.op11_periodic_runs(spark, data).collect(), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    periodic = 0
    for doc_id, text in docs_of(spark, data, "text"):
        words = made_words(doc_id, text)
        if len(words) > 3000:
            continue  # the plain version is quadratic; test_long_texts has such
        want = brute.runs(words)
        best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        rest = " ".join(w for i, w in enumerate(words) if i not in dropped)
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[doc_id] == (len(want), *numbers, brute.sha(listed.encode()), brute.sha(rest.encode()))
        periodic += len(want)
    assert periodic or "sf0" not in data


def test_runs_of_made_sequences():
    rng = random.Random(11)
    for _ in range(1500):
        n, kinds = rng.randint(0, 260), rng.choice([1, 2, 3, 6, 30])
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 20 else 0):
            q, a = rng.randint(1, n // 2), rng.randrange(n)
            for i in range(a + q, rng.randint(a, n)):
                words[i] = words[i - q]
        assert runs.find_runs(words) == brute.runs(words)


def test_runs_of_long_texts():
    rng = random.Random(12)
    assert runs.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    period = [str(rng.randrange(10_000)) for _ in range(1234)]
    noise = [f"x{i}" for i in range(100_000)]
    words = noise + period * 3 + period[:7] + ["end"] + noise
    assert runs.find_runs(words) == [(100_000, 3 * 1234 + 7, 1234)]
    assert runs.collapsed(words, runs.find_runs(words)) == noise + period + ["end"] + noise


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_query(spark, data):
    own = library()
    got = of(queries.op12_token_counts(spark, data).collect(), "n_bytes", "n_tokens", "over_limit")
    for doc_id, text in docs_of(spark, data, "text"):
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        assert got[doc_id] == (len((text or "").encode()), n, n > 1024)


ODD = ["", None, "a<|endoftext|>b", "<|endoftext|><|endoftext|", " <|endoftext|>\n", "it's IT'S ''s", "x\x85y\xa0z\x1cw", "𝒳🙂 日本語 ͸", "\n\n  a  b\t\tc ", "z" * 30_000, " " * 5000, "½²x٣", "<|startoftext|>Ab"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("known", [0, 1 << 19])
def test_token_counts_of_odd_texts(spark, monkeypatch, name, known):
    monkeypatch.setattr(tokens, "KNOWN_TOKENS", known)
    rng = random.Random(13)
    texts = ODD * 2 + ["".join(rng.choice("ab 's't  \n\t129.,!<|>éß日😀\x85") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i // 2, t, 7) for i, t in enumerate(texts)], "row long, text string, known int").repartition(3)
    own = Tokenizer.from_file(public_tokenizers.path(name))
    got = tokens.token_counts(df, [F.col("row"), F.col("known"), F.col("text")], F.col("text"), tokens.load_model(public_tokenizers.path(name)))
    assert got.columns == ["row", "known", "text", "n_tokens"]
    want = Counter((i // 2, 7, t, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert Counter(map(tuple, got.collect())) == want


def test_pre_tokens_of_every_character():
    pre, own = tokens.PreTokens(tokens.load_model(public_tokenizers.path("byte_bpe_50k.json"))), library()
    seen = 0
    for c in range(0x10000):
        if not pre.odd.match(chr(c)):
            text = f"a{chr(c)}1{chr(c)} {chr(c)}.{chr(c)}\n\n{chr(c)}{chr(c)}"
            assert pre.pattern.findall(text) == [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)], hex(c)
            seen += 1
    assert seen > 50_000


def test_the_table_for_tasks_is_bounded(spark, monkeypatch):
    rows = [(f"t{i}", 1 << (i % 9), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "token string, n long, pieces int")
    for most in (0, 150, 5000):
        monkeypatch.setattr(tokens, "KNOWN_TOKENS", most)
        least, known = tokens._frequent(df)
        assert len(known) <= most and set(known) == {t for t, n, _ in rows if n >= 2**least}
    assert len(known) == 900


def test_phrases_query(spark, data):
    want = brute.phrases(spark.read.parquet(f"{data}/documents.parquet").select("lang", "text").collect(), 30, 80, 2000)
    got = queries.op13_phrases(spark, data).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == want
    assert want or "sf0" not in data


@pytest.mark.parametrize("sizes", [{}, {"filter_bits": 1 << 16, "shard_words": 50}])
def test_phrases_of_made_texts(spark, sizes):
    """Small shards, and maps so full that they leave out little, give the same phrases."""
    rng = random.Random(14)
    letters = ["A", "b", "C", "dd", "é", "É", "日", "\x1cx", "\xa0"]
    texts = [(rng.choice(["en", None, "und", "de"]), rng.choice([None, "", ". ,"]) if rng.random() < 0.1 else "".join(rng.choice(letters) + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n"]) for _ in range(rng.randint(1, 80)))) for _ in range(150)]
    texts += texts[:9] + [("en", "a b c d e f g " * 400)]
    df = spark.createDataFrame(texts, "lang string, text string").withColumns({"phrase": F.lit(1), "n": F.lit(2)}).repartition(5)
    for least, percent, top in ((3, 80, 40), (2, 100, 1000), (1, 50, 100_000)):
        got = phrases.collocations(df, F.col("text"), F.col("lang"), least, percent, top, **sizes)
        assert sorted(map(tuple, got.collect())) == brute.phrases([(a, b) for a, b in texts], least, percent, top)


def test_suffix_array_and_ngrams():
    rng = random.Random(15)
    for _ in range(200):
        ids = np.array([rng.randrange(4) for _ in range(rng.randint(0, 60))], np.int32)
        for depth in (1, 2, 3, 4, 9):
            order, reach = phrases.suffix_array(ids, depth)
            heads = [tuple(ids[i : i + min(depth, reach[i])]) for i in order]
            assert heads == sorted(heads) and sorted(order) == [i for i, x in enumerate(ids) if x]
        for n, at, count in phrases.ngram_counts(ids, 1, 4):
            want = Counter(tuple(ids[i : i + n]) for i in range(len(ids) - n + 1) if ids[i : i + n].all())
            assert {tuple(ids[i : i + n]): c for i, c in zip(at, count)} == dict(want)


def test_batches_are_bounded_by_bytes(spark):
    """Long texts don't fill a worker: a batch of Arrow rows ends with its bytes, whatever the setting of rows."""
    df = spark.range(0, 120, 1, 1).select(F.repeat(F.lit("x"), 2_000_000).alias("text"))
    sizes = [r["n"] for r in df.mapInArrow(lambda batches: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(sizes) == 120 and max(sizes) <= 60


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(None, "a b " * 20, None, None, None, 1, 2, "x")] * 3 + [(5, "a b " * 20, None, None, None, 1, 2, "x"), (5, "c", "en", None, None, 1, 2, "x")]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["n_runs"], r["period"] or 0) for r in found) == [(False, 0, 0), (False, 1, 2), (True, 1, 2), (True, 1, 2), (True, 1, 2)]
    found = queries.op12_token_counts(spark, str(tmp_path)).collect()
    assert len(found) == 5 and len({r["n_tokens"] for r in found}) == 2
    found = queries.op13_phrases(spark, str(tmp_path)).collect()
    assert {(r["lang"], r["n"]) for r in found} == {("und", 160)}
