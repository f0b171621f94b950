"""What the findings of round 3 left open in the training-data operators."""

import gc
import random

from lodestrata.llm import line_dedup, pieces
from tests.llm import brute


def _misspelt(rng, line, share):
    """line with that share of its letters replaced, doubled or left out, wherever they stand."""
    letters = lambda c: rng.choice((rng.choice("abcdefghij"), c + c, "")) if c != " " and rng.random() < share else c
    return " ".join("".join(map(letters, line)).split())


def test_exact_line_dedup_links_lines_with_an_edit_in_every_word(spark):
    """Every pair of lines is held against edit similarity alone; blocks of words leave many of these out."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    lines = []
    for i in range(60):
        line = " ".join(word() for _ in range((5, 6, 8, 12, 20, 40)[i % 6]))
        lines += [line, _misspelt(rng, line, 0.08), _misspelt(rng, line, 0.16)]
    # 20 and 25 characters: lengths at the very limit
    lines += ["aaa bbb ccc ddd eeee", "aaa bbb ccc ddd eeee xxxx", "one two three four"]
    docs = list(enumerate(lines))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: t for d, (_, _, t) in brute.line_dedup(docs).items()}
    exact = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, exact=True).collect()}
    assert exact == want
    assert sum(not t for t in want.values()) > 100


def test_exact_line_dedup_deals_many_lines_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRED_LINES", 7)
    rng = random.Random(32)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    lines = []
    for _ in range(40):
        line = " ".join(word() for _ in range(8))
        lines += [line, _misspelt(rng, line, 0.15)]
    docs = list(enumerate(lines))
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), exact=True)
    assert {r.doc_id: r.text for r in found.collect()} == {d: t for d, (_, _, t) in brute.line_dedup(docs).items()}


def test_exact_line_dedup_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, "a b c d e"), (2, "a b")], "doc_id long, text string")
    got = {(r.doc_id, r.text, r._removed) for r in line_dedup.dedup_lines(df, exact=True).collect()}
    assert got == {(1, None, 0), (None, "a b c d e", 0), (2, "a b", 0)}


def test_pieces_of_words_take_few_steps():
    """A worker meets most words of a corpus once; their best paths are as brute force has them, and no cycles are sought meanwhile."""
    model = pieces.load_model()
    ready = pieces._ready(model)
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("theonarñß語\t") for _ in range(rng.randint(0, 14)))
    score = {p: s for p, s, k in pieces.read_model(model) if k in (1, 4)}
    ids = {p: i for i, (p, _, _) in enumerate(pieces.read_model(model))}

    def best(part):
        found = [(0.0, ())]
        for end in range(1, len(part) + 1):
            ways = [(found[at][0] + score[part[at:end]], (*found[at][1], ids[part[at:end]])) for at in range(end) if part[at:end] in score]
            if part[end - 1] not in ready.covered:
                ways.append((found[-1][0] + ready.byte_score, (*found[-1][1], *(ready.id_of_byte[b] for b in part[end - 1].encode()))))
            found.append(max(ways, key=lambda w: w[0]))
        return found[-1]

    for part in [pieces.MARK + word() for _ in range(3000)] + ["", "語", "語語a", "a語"]:
        assert ready.viterbi(part) == best(part)[1]
    assert gc.isenabled()
    with pieces._uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
