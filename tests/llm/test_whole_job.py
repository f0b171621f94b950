"""What a review found the operators to leave out."""

import glob
import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import line_dedup, quality, queries, sharding
from tests.llm import brute


def _edited_lines(rng):
    """Lines of 5 to 40 words, each with a copy of one word replaced, and one with edits up to a similarity of about 0.8."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(400)]
    lines = []
    for i in range(90):
        words = [rng.choice(vocabulary) for _ in range((5, 6, 8, 10, 13, 20, 27, 30, 40)[i % 9])]
        one, many = list(words), list(words)
        one[rng.randrange(len(one))] = word()
        for k in rng.sample(range(len(many)), max(1, len(many) // 5)):
            many[k] = rng.choice((many[k][:-1] + "xy", word()))
        lines += [" ".join(words), " ".join(one), " ".join(many)]
    return lines


def _links(spark, lines):
    """The pairs of places that are in one group."""
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    occurrences, firsts = line_dedup.line_groups(df, "doc_id", "text")
    return {r.id: r.first.id if r.first else r.id for r in occurrences.join(firsts, "h", "left").collect()}


def test_line_dedup_finds_lines_at_the_edit_similarity(spark):
    lines = _edited_lines(random.Random(8))
    group = _links(spark, lines)
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if abs(len(lines[a]) - len(lines[b])) <= 0.2 * max(len(lines[a]), len(lines[b]))]
    pairs = [(a, b) for a, b in pairs if len(set(lines[a]) ^ set(lines[b])) < 20 and a // 3 == b // 3 or group[a] == group[b]]
    similar = [(a, b) for a, b in pairs if brute.edits(lines[a], lines[b]) <= int(0.2 * max(len(lines[a]), len(lines[b])))]
    found = sum(group[a] == group[b] for a, b in similar)
    print(f"recall {found} of {len(similar)}")
    assert len(similar) > 120 and found >= 0.97 * len(similar)


def test_line_dedup_holds_against_edit_similarity_alone(spark, tiny):
    """Every pair of the table's lines is compared, whatever words they share."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    occurrences, firsts = line_dedup.line_groups(docs, "doc_id", "text")
    group = {r.h: r.first for r in firsts.collect()}
    line = F.explode(F.split(line_dedup.normalised(F.col("text")), "\n"))
    words = docs.select(line.alias("line")).select(line_dedup.words_of(F.col("line")).alias("w")).filter(F.size("w") >= 5).distinct()
    norms = words.select(F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("t")).cache()
    a, b = (norms.select(F.col("h").alias(f"h{s}"), F.col("t").alias(f"t{s}")) for s in "ab")
    most = "cast(greatest(length(ta), length(tb)) * 200 div 1000 as int)"
    pairs = a.join(b, F.expr(f"ha < hb and abs(length(ta) - length(tb)) <= {most}")).repartition(8)
    similar = pairs.filter(F.expr(f"levenshtein(ta, tb, {most}) >= 0")).select("ha", "hb").collect()
    found = sum(r.ha in group and group[r.ha] == group.get(r.hb) for r in similar)
    print(f"recall {found} of {len(similar)} pairs of {len(group)} lines")
    assert len(similar) > 30 and found >= 0.99 * len(similar)


def test_line_dedup_sums_bits_of_huge_lines_and_repeated_rows(spark):
    huge = " ".join(f"w{i}" for i in range(100_000))
    alike = "one and the same word " * 14_000
    line = "the quick brown fox jumps over the lazy dog"
    rows = [(1, huge), (2, huge + "\n" + line), (4, alike), (5, alike)] + [(3, line)] * 6000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (huge, 0), 2: (line, 1), 3: ("", 1), 4: (alike, 0), 5: ("", 1)}
    # the exact fingerprint
    occurrences = line_dedup._occurrences(df.filter("doc_id in (1, 3)"), "doc_id", "text")
    found = line_dedup._distinct(occurrences, line_dedup._long(occurrences)).collect()
    import xxhash

    def want(text):
        words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in text.split(" ")]
        return sum(1 << b for b in range(60) if 2 * sum(w >> b & 1 for w in words) > len(words))

    assert {r.first.id: r.sim for r in found} == {1: want(huge), 3: want(line)}


def test_line_dedup_takes_any_columns_ids_and_short_lines(spark):
    """Names that clash, one id for different texts, equal short lines, lines without words."""
    rows = [(1, "a b\n\n--\nx", 7, "g"), (1, "a b\ny z", 8, "h"), (2, "A, b!\n\n--", 9, None), (None, "a b", 1, "n"), (3, None, 2, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone long, row string")
    df = df.withColumns({"lines": F.lit(1), "h": F.lit(2), "first": F.lit(3), "id": F.lit("i"), "doc": F.lit("d")})
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "_lines", "_removed"]
    found = {(r.doc_id, r.gone): (r.text, r._lines, r._removed) for r in got.collect()}
    assert found.pop((None, 1)) == ("a b", 1, 0) and found.pop((3, 2)) == (None, 0, 0) and found.pop((2, 9)) == ("\n--", 3, 1)
    assert sorted(found.values()) in ([("\n--\nx", 4, 1), ("a b\ny z", 2, 0)], [("a b\n\n--\nx", 4, 0), ("y z", 2, 1)])
    kept = df.withColumns({"_lines": F.lit(5), "_removed": F.lit(6)}).drop("gone", "row")
    assert {(r._lines, r._removed) for r in corpus_pipeline.line_stage(spark, kept, "").collect()} == {(5, 6)}


def test_near_duplicate_stage_takes_five_words_at_80_percent(spark):
    rng = random.Random(12)
    rows = []
    for i in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for k in range(20, 300, (50, 43, 60, 30)[i % 4]):
            words[k] = f"new{k}"
        rows.append((2 * i + 1, " ".join(words)))
    sets = {d: brute.shingles(t, size=5) for d, t in rows}
    near = {a + 1 for a in range(0, 24, 2) if 100 * len(sets[a] & sets[a + 1]) >= 80 * len(sets[a] | sets[a + 1])}
    assert 3 <= len(near) < 12
    left = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in left.collect()} == set(sets) - near


def test_near_duplicate_stage_keeps_different_texts_of_one_id(spark):
    """One id for different texts, rows that repeat, null ids, column names that clash."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 9000)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, a), (2, c), (2, c), (None, a), (3, None), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit("i"), "_row": F.lit("r"), "_lost": F.lit(1), "_text": F.lit("t")})
    left = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert left.columns == df.columns
    want = [(1, a), (1, b), (2, c), (None, a), (3, None), (4, ""), (4, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, want))
    plain = corpus_pipeline.near_duplicate_stage(spark, df.filter("doc_id = 4 or doc_id = 2 and text <> '" + a + "'"), "")
    assert sorted(r.doc_id for r in plain.collect()) == [2, 4, 4]


def test_quality_limits_lines_alike_on_a_large_host(spark):
    """A footer in 1 % of a host's texts is as much boilerplate as in 21 of a small host's."""
    own, footer = F.concat(F.lit("own words number "), F.col("id")), "all rights reserved by the owners of this site"
    for host, every in ((12_000, 100), (200, 8)):
        docs = spark.range(host).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.when(F.col("id") % every == 0, F.concat(F.lit(footer + "\n"), own)).otherwise(own).alias("text"))
        rows = quality.quality_rules(docs).filter("removed_words > 0").collect()
        assert {r.doc_id for r in rows} == set(range(0, host, every)) and all(r.removed_words == 9 and r.depleted for r in rows)


def test_shuffle_bounds_buckets_by_bytes_and_spreads_repeats(spark):
    """Long texts, rows with one id, rows with none and rows that repeat altogether: no bucket grows with them."""
    rows = [(i, "x" * 40_000) for i in range(60)] + [(None, f"t{i}") for i in range(2000)] + [(7, f"u{i}") for i in range(2000)] + [(8, "same")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, total = sharding.buckets(df, "doc_id", 7, bucket_bytes=400_000)
    sizes = found.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(F.length("_r.text")).alias("b")).collect()
    assert total == len(rows) and max(r.n for r in sizes) <= 1024 and max(r.b for r in sizes) <= 1_600_000
    placed = sharding.external_shuffle(df, "doc_id", 9, bucket_bytes=400_000)
    out = placed.collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(a), b) for a, b in rows)
    at = {}
    for r in out:
        at.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in at.values()) and max(map(len, at.values())) - min(map(len, at.values())) <= 1


def test_shuffle_query_writes_whole_documents(spark, tiny):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/lodestrata-shards-*"))
    found = queries.op8_external_shuffle(spark, tiny)
    (path,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/lodestrata-shards-*")) - before
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    back = spark.read.parquet(path)
    assert back.columns == [*docs.columns, "slot", "shard"]
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sorted((r.doc_id, r.shard, r.slot) for r in found.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in back.collect())
