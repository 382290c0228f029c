"""Search and graph operators against plain Python."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvane.operators.components import connected_components
from corvane.operators.dense import nearest, usable
from corvane.operators.fusion import diversified, reciprocal_ranks
from corvane.operators.community import inner_relations, member_digests, pending, shown_members, themes
from corvane.operators.graph import communities, modularity, neighbours, personalised_pagerank
from corvane.operators.lexical import bm25
from corvane.operators.ordered import fill_forward, running_sum
from corvane.operators.merge import merge_groups, repointed
from corvane.operators.sections import packed
from corvane.operators.substrings import contained


def test_bm25_formula(spark):
    texts = {1: "red fox red", 2: "the fox runs", 3: "two-factor login", 4: "two factor", 5: None, 6: ""}
    docs = spark.createDataFrame([(k, v, "fox" if k == 3 else None) for k, v in texts.items()], "id long, text string, title string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "two-factor"), (3, "absent"), (4, "fox fox"), (5, None)], "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in bm25(docs, {"text": 1.0, "title": 2.0}, asked).collect()}
    tokens = {1: (["red", "fox", "red"], []), 2: (["the", "fox", "runs"], []), 3: (["two", "factor", "login"], ["fox"]), 4: (["two", "factor"], []), 5: ([], []), 6: ([], [])}
    mean = sum(len(a) + len(b) for a, b in tokens.values()) / 6

    def score(terms, k):
        total = 0.0
        for t in terms:
            n = sum(t in a or t in b for a, b in tokens.values())
            a, b = tokens[k]
            f = a.count(t) + 2.0 * b.count(t)
            idf = math.log((6 - n + 0.5) / (n + 0.5))
            idf = idf if idf > 0 else 1e-6
            total += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(a) + len(b)) / mean)) if f else 0
        return round(total, 9)

    assert got[1, 1] == score(["red", "fox"], 1) and got[1, 3] == score(["fox"], 3) and got[4, 2] == score(["fox", "fox"], 2)
    assert {k for k in got if k[0] == 2} == {(2, 3), (2, 4)} and not {k for k in got if k[0] in (3, 5)}


def test_nearest_and_usable(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [("s1", rows[1][1]), ("nan", [float("nan")] * 8), ("zero", [0.0] * 8), ("short", [1.0] * 4), ("null", None), (None, [1.0] * 8)]
    good = usable(spark.createDataFrame(rows, "sha string, vec array<float>"), 8)
    assert good.count() == 60
    found = nearest(good.selectExpr("sha AS query_id", "sha AS own", "vec"), good.withColumnRenamed("sha", "id"), 3, query_rows=16, vector_rows=20).collect()
    x = np.array([r[1] for r in rows[:60]], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    for i in range(60):
        want = [f"s{j}" for j in np.argsort(-sim[i])[:3]]
        assert [r.id for r in sorted((r for r in found if r.query_id == f"s{i}"), key=lambda r: r.place)] == want


def greedy(rows, limit, areas):
    seen, documents, used, out = set(), Counter(), set(), []
    need = min(areas, len({r[3] for r in rows}))
    for r in rows:
        chunk, doc, heading, area = r
        if len(used) < areas and need >= areas and area in used:
            continue
        if len(used) < areas and need < areas and area in used:
            continue
        used.add(area)
        out.append(r)
    kept = []
    for chunk, doc, heading, area in out:
        if (doc, heading) in seen or documents[doc] >= 2:
            continue
        seen.add((doc, heading))
        documents[doc] += 1
        kept.append(chunk)
    return kept[:limit]


def test_diversity_against_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(40):
        listed = [(i, rng.randrange(6), rng.randrange(3), rng.randrange(rng.choice([3, 8]))) for i in range(rng.randrange(1, 25))]
        rows += [(q, c, d, str(h), str(a), float(-c)) for c, d, h, a in listed]
        want[q] = (greedy([(c, d, h, a) for c, d, h, a in listed], 8, 0), greedy([(c, d, h, a) for c, d, h, a in listed], 8, 5))
    df = spark.createDataFrame(rows, "query_id long, id long, doc_id long, heading string, area string, score double")
    for k, areas in ((0, 0), (1, 5)):
        got = {}
        for r in diversified(df, 8, areas=areas).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: w[k] for q, w in want.items() if w[k]}


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, place int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, id long, place int")
    got = {r.id: r.fused for r in reciprocal_ranks(a, b).collect()}
    assert got[11] == 1.0 and got[10] == round((1 / 61) / (1 / 61 + 1 / 62), 9)


def test_pagerank_and_neighbours(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.random()) for _ in range(30)]
    df = spark.createDataFrame([(*e, "k") for e in edges], "src string, dst string, weight double, kind string")
    seeds = spark.createDataFrame([(1, "n0", 1.0), (1, "gone", 5.0), (2, "gone", 1.0)], "query_id long, node string, mass double")
    got = {r.node: r.score for r in personalised_pagerank(df, seeds).collect()}
    w = np.zeros((12, 12))
    for a, b, x in edges:
        w[int(a[1:]), int(b[1:])] += x
        w[int(b[1:]), int(a[1:])] += x
    p = np.divide(w, w.sum(axis=1, keepdims=True), where=w.sum(axis=1, keepdims=True) > 0, out=np.zeros_like(w))
    r = np.zeros(12)
    r[0] = 1
    x = r
    for _ in range(7):
        x = 0.18 * r + 0.82 * x @ p
    want = x / x.max()
    assert all(abs(got.get(f"n{i}", 0.0) - want[i]) < 1e-9 for i in range(12))
    near = neighbours(df, spark.createDataFrame([("n0",)], "node string"), 2).collect()
    assert len(near) == 2 and near[0].weight >= near[1].weight


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 10), (20, 20), (None, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[11] == 10 and got[20] == 20 and got[140] == 100 and 5 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_communities(spark):
    edges = [(f"a{i}", f"a{j}", 1.0) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("z", "z", 1.0)]
    found = communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.community, set()).add(r.node[0])
    assert len(found) == 10 and sorted(map(sorted, groups.values())) == [["a"], ["b"]]


def test_scans_in_blocks(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, None, i])) for k in ("x", None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").selectExpr("*", "int(i / 16) AS part")
    filled = fill_forward(df, ["k"], "part", ["i"], df["v"], "last")
    before = fill_forward(df, ["k"], "part", ["i"], df["v"], "last", before=True)
    total = running_sum(df, ["k"], "part", ["i"], df["v"], "total")
    want, earlier, sums = {}, {}, {}
    for k, i, v in rows:
        earlier[k, i] = want.get((k, i - 1))
        want[k, i] = v if v is not None else want.get((k, i - 1))
        sums[k, i] = sums.get((k, i - 1), 0) + (v or 0)
    assert {(r.k, r.i): r["last"] for r in filled.collect()} == want
    assert {(r.k, r.i): r["last"] for r in before.collect()} == earlier
    assert {(r.k, r.i): r.total for r in total.collect()} == sums


def test_sections():
    text = "---\na: b\n---\nIntro words here\n# One\n### Deep\n" + "w " * 30 + "\n### Other\nshort tail\n"
    got = packed(text, 20, 5, 3)
    assert [g[0] for g in got] == ["Document", "One › Deep"] and got[0][1] == 4
    assert got[1][2].endswith("short tail")  # a short end joins the chunk before, also under another heading
    assert packed("", 20, 5, 3) == [] and packed("few", 20, 5, 3) == [("Document", 1, "few")]


def test_contained(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc-") for _ in range(rng.randrange(0, 9))) for _ in range(80)]
    needles = ["".join(rng.choice("abc-") for _ in range(rng.randrange(0, 5))) for _ in range(60)]
    a = spark.createDataFrame([*enumerate(needles), (999, None)], "needle_id long, needle string")
    b = spark.createDataFrame([*enumerate(texts), (999, None)], "text_id long, text string")
    want = {(i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n and n in t}
    assert {tuple(r) for r in contained(a, b).collect()} == want and len(want) > 50
    assert contained(a.where("false"), b).count() == contained(a, b.where("false")).count() == 0


def test_merge(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    rows = [(1, "ibm", "IBM", 3), (2, "big-blue", "Big Blue", 9), (3, "i-b-m", "I. B. M. Corporation", 9), (4, "x", "X", 50), (5, "p", None, 0), (6, "q", "Q", 0)]
    entities = spark.createDataFrame(rows, "node long, norm string, name string, mentions long")
    got = {r.node: (r.component, r.keeper, r.label) for r in merge_groups(pairs, entities).collect()}
    assert got == {**{k: (1, 2, "I. B. M. Corporation") for k in (1, 2, 3)}, 5: (5, 5, "Q"), 6: (5, 5, "Q")}
    relations = [("ibm", "x", "t", 1.0), ("big-blue", "x", "t", 2.0), ("i-b-m", "ibm", "t", 1.0), ("x", "i-b-m", "u", 4.0), ("x", "ibm", "u", 5.0)]
    moved = spark.createDataFrame([("ibm", "big-blue"), ("i-b-m", "big-blue")], "norm string, keeper_norm string")
    out = repointed(spark.createDataFrame(relations, "src string, dst string, type string, weight double"), moved)
    assert {tuple(r) for r in out.collect()} == {("big-blue", "x", "t", 2.0), ("x", "big-blue", "u", 4.0)}


def test_community_context(spark):
    members = spark.createDataFrame([("g", f"n{k}") for k in range(5)] + [("h", "n9")], "community string, node string")
    seen = spark.createDataFrame([("n3", 7), ("n1", 7)], "node string, mentions long")
    shown = {(r.community, r.place): (r.node, r.mentions, r.members) for r in shown_members(members, seen, 3).collect()}
    assert shown == {("g", 1): ("n1", 7, 5), ("g", 2): ("n3", 7, 5), ("g", 3): ("n0", 0, 5), ("h", 1): ("n9", 0, 1)}
    relations = spark.createDataFrame([("n1", "n3", "t", 1.0), ("n1", "n9", "t", 9.0), ("n3", "n0", "t", 2.0), ("n4", "n1", "t", 5.0)], "src string, dst string, type string, weight double")
    inner = inner_relations(shown_members(members, seen, 3), relations)
    assert [(r.src, r.dst, r.place) for r in inner.orderBy("place").collect()] == [("n3", "n0", 1), ("n1", "n3", 2)]
    digests = member_digests(members)
    summaries = digests.withColumn("digest", F.when(F.col("community") == "g", F.lit("older")).otherwise(F.col("digest")))
    assert [r.community for r in pending(digests, summaries).collect()] == ["g"] and pending(digests, digests).count() == 0
    asked = spark.createDataFrame([(1, ["cost", "audit"], [1.0, 0.0]), (2, [], None)], "query_id long, terms array<string>, vec array<double>")
    told = spark.createDataFrame([("g", ["audit"], 8.0, [0.6, 0.8]), ("h", ["x"], 5.0, None)], "community string, terms array<string>, rating double, vec array<double>")
    scores = {(r.query_id, r.community): (r.score, r.place) for r in themes(asked, told).collect()}
    assert scores[1, "g"] == (round(0.6 * 0.6 + 0.25 * 0.5 + 0.12, 9), 1) and scores[2, "g"] == (0.12, 1) and scores[1, "h"] == (0.075, 2)


def test_communities_settle(spark):
    """As good as moving nodes one by one, on a graph with planted groups."""
    rng = random.Random(9)
    edges = {(min(a, b), max(a, b)) for a in range(120) for b in range(a) if rng.random() < (0.4 if a // 15 == b // 15 else 0.02)}
    df = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in edges], "src string, dst string, weight double")
    found = communities(df, least=1).cache()
    planted = spark.createDataFrame([(f"n{a}", str(a // 15)) for a in range(120)], "node string, community string")
    ours, best = modularity(df, found).head(), modularity(df, planted).head()
    assert found.count() == found.select("node").distinct().count() == len({n for e in edges for n in e})
    degree = Counter(n for e in edges for n in e)
    by_hand = sum(1 for a, b in edges if a // 15 == b // 15) / len(edges) - sum(sum(degree[n] for n in range(15 * g, 15 * g + 15)) ** 2 for g in range(8)) / (2 * len(edges)) ** 2
    assert abs(best.modularity - by_hand) < 1e-9 and ours.modularity >= best.modularity - 0.02
