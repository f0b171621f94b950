"""Findings of round 3, second reply: what a round of the components costs the driver."""

import random

from lodestrata.llm import components


def _least(links):
    least = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_round_of_components_is_a_small_plan(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2)], "a long, b long")
    plan = components._stars(edges)._jdf.queryExecution().optimizedPlan().toString()
    # each step joins the edges with their least neighbours once (the first step's edges are read by both sides of the second's
    # join), and nothing is worked out for both directions of an edge; there were four joins and seven unions before
    assert plan.count("Join ") <= 3
    assert "Union" not in plan


def test_components_of_chains_stars_and_chance(spark):
    rng = random.Random(51)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 50)] + [(499, 549)]
    chance = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    links = [x if rng.random() < 0.5 else x[::-1] for x in chain + star + chance + chain[:9]]
    want = _least([x for x in links if x[0] != x[1]])
    got = [tuple(r) for r in components.components(spark.createDataFrame([*links, (7, None), (8, 8)], "a long, b long")).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_components_of_structs_and_of_nothing(spark):
    pairs = spark.createDataFrame([((2, "x"), (1, "y")), ((2, "x"), (3, "z"))], "a struct<i:long,t:string>, b struct<i:long,t:string>")
    got = {tuple(r.id): tuple(r.component) for r in components.components(pairs).collect()}
    assert got == {(1, "y"): (1, "y"), (2, "x"): (1, "y"), (3, "z"): (1, "y")}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
