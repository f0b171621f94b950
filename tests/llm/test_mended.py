"""Cases that once went wrong: shared ids, repetitive texts, columns named like helpers."""

import glob
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import mixing, ngram_join, quality, suffixes
from tests.llm import brute

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _near(rng, base):
    return " ".join(w if i != 7 else f"x{rng.randrange(10**6)}" for i, w in enumerate(base))


@pytest.mark.parametrize("backwards", [False, True])
def test_texts_of_one_id_link_all_they_are_near_to(spark, backwards):
    rng = random.Random(21)
    one, two = ([f"{p}{rng.randrange(10**6)}" for _ in range(120)] for p in "ab")
    rows = [(1, _near(rng, one)), (1, _near(rng, two)), (2, _near(rng, one)), (3, _near(rng, two)), (4, "alone"), (1, None), (None, " ".join(one))]
    df = spark.createDataFrame(rows[::-1] if backwards else rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id or 0), r.component_id or 0) for r in ngram_join.jaccard_components(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_repetitive_texts(spark):
    rng = random.Random(22)
    piece = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    word, passage = piece(7), piece(70)
    texts = ["a" * 60, "a" * 45, "b" + "a" * 40 + "c", "a" * 39 + "d", (word * 20) + "x", word[3:] + word * 6, "-" * 80 + passage + "=" * 64, passage[:50] + "=" * 50, "ab" * 30 + "abc" * 30 + "ba" * 25, "z" * 41, piece(300), ""]
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=40).collect()}
    want = brute.repeats(docs, 40)
    assert got == want and any(n for _, n, _, _ in want.values())


def test_long_repetitive_texts_have_few_anchors(spark):
    for data in (b"a" * 5_000_000, b"abc" * 1_700_000, b" \n" * 1_000_000):
        began = time.time()
        places, repeats = suffixes.anchors(data)
        assert len(places) <= 32 and {(0, len(data))} == set(suffixes.united(repeats)) and time.time() - began < 30
    df = spark.createDataFrame([(1, "a" * 5_000_000), (2, "x" + "abc" * 1_700_000 + "y"), (3, "a" * 400), (4, "a" * 399)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}
    assert got == {1: (5_000_000, 1, b""), 2: (5_100_000, 1, b"xy"), 3: (400, 1, b""), 4: (0, 0, b"a" * 399)}


def _helper_names():
    found = set()
    for path in [*glob.glob(f"{HERE}/lodestrata/llm/*.py"), f"{HERE}/corpus_pipeline.py"]:
        with open(path) as f:
            found |= set(re.findall(r'"(_?[A-Za-z][A-Za-z0-9_]{0,20})"', f.read()))
    own = {"doc_id", "text", "lang", "source", "n_chars"}
    return sorted({x.lower(): x for x in found if x.lower() not in own}.values())


def test_stages_take_columns_named_like_their_helpers(spark, tiny):
    names = _helper_names()
    assert len(names) > 150 and {"_input", "_removed_words", "_found_key", "_plan_id", "_plan_one", "_row", "_decoded", "piece_ids", "n_pieces", "round_trip"} - set(names) <= {"_found_key", "_plan_id", "_plan_one", "_decoded"}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), tiny).select("doc_id", "text").collect()
        found = stage(spark, docs, tiny)
        assert found.columns[: len(docs.columns)] == docs.columns, name
        rows = found.select("doc_id", "text", F.to_json(F.struct(*names)).alias("extra")).collect()
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in plain), name
        assert all(f'"{n}":"{n}:{r.doc_id}"' in r.extra for r in rows[:40] for n in names), name


def test_frequent_lines_keep_other_columns(spark):
    rows = [(f"line\nown words {i}", "h", i, "f") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, source string, _row int, _key2 string")
    got = quality.without_frequent_lines(df).collect()
    assert sorted((r["_row"], r.text, r["_key2"], r["_removed_words"]) for r in got) == [(i, f"own words {i}", "f", 1) for i in range(60)]


def test_rows_without_an_id_do_not_share_a_chunk(spark, monkeypatch):
    rows = spark.range(4000).select(F.when(F.col("id") >= 3000, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), 7).alias("text"))
    rows = rows.unionByName(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.repeat(F.lit("w "), 9).alias("text")))
    largest = []
    monkeypatch.setattr(mixing, "written", lambda df, keep=mixing.written: _noted(keep(df), largest))
    mixed = mixing.mix_sources(rows)
    taken = {r.source: (r.taken, r.target) for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(taken_ - target) <= 16 for taken_, target in taken.values()) and mixed.count() == 8000
    assert max(largest) <= 4 * mixing.CHUNK


def _noted(df, largest):
    """df, after the number of units that its largest chunk has was noted."""
    if "_f" in df.columns:
        largest.append(df.select((F.size("_f.done") + 1).alias("n")).agg(F.max("n")).first()[0])
    return df
