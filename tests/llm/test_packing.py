import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.packing import Plan, best_fit, pack


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(11, 100), st.integers(1, 60), max_size=40), st.integers(1, 30))
def test_plan_places_all(histogram, groups):
    import numpy as np

    plan = Plan(histogram, 100, 10, groups)
    used, ranks = Counter(), Counter()
    for size, count in histogram.items():
        g = int(plan.group_of[size])
        places = plan.place(np.full(count, g), np.arange(ranks[g], ranks[g] + count))
        ranks[g] += count
        for c in places:
            used[int(c)] += size
    assert sum(used.values()) == sum(s * n for s, n in histogram.items())
    assert all(v <= 100 for v in used.values()) and len(used) == plan.containers


def test_best_fit():
    assert best_fit([(5, 1), (9, 2)], [5, 4, 4, 1, 8], 10, 100) == [1, 100, 100, 2, 2]
    assert best_fit([], [], 10, 0) == []


def test_pack(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([rng.randrange(1, 120), rng.randrange(100, 300), 700]))) for _ in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (0, texts[0], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = pack(df, capacity=256, shard=50).collect()
    used = Counter()
    for r in out:
        used[r.container] += r.tokens
    total = sum(used.values())
    assert max(used.values()) <= 256 and total / (len(used) * 256) > 0.93
    pieces = Counter((r.doc_id, r.piece) for r in out)
    assert pieces[0, 0] == 2 and all(n == 1 for (d, _), n in pieces.items() if d != 0)
    assert {d for d, _ in pieces} == {*range(400), None}
    sizes = {}
    for r in out:
        sizes.setdefault(r.doc_id, []).append((r.piece, r.tokens))
    assert all([t for _, t in sorted(p)][:-1] == [256] * (len(p) - 1) for d, p in sizes.items() if d)
    again = {(r.doc_id, r.piece, r.tokens): r.container for r in pack(df.where("doc_id <> 0"), 256, shard=50).collect()}
    once = {(r.doc_id, r.piece, r.tokens): r.container for r in pack(df.where("doc_id <> 0"), 256, shard=50).collect()}
    assert again == once
    assert pack(df.where("false")).count() == 0
    assert pack(df.where("length(text) > 1500"), 256).count() > 0
    assert pack(df.where("length(text) < 40"), 256).count() > 0
