import random

import pytest

import numpy as np

from corvane.llm.subjects import AreaModels, dealt_with, ngrams, sentences, subject_areas, terms

AREAS = {"sport": ["goal", "team captain", "cup final", "tie break"], "law": ["contract clause", "tribunal", "court filing", "lease"], "food": ["bread oven", "salt", "kitchen knife", "menu"]}
FRAMES = ["The {} was moved to May.", "We talked about the {} at length.", "Please check the {} twice.", "A draft of the {} is in the folder."]
PLAIN = ["Nothing else came up.", "The next date is still open.", "Ann took the minutes this time."]


def note(rng, areas, n):
    lines = [rng.choice(FRAMES).format(rng.choice(AREAS[rng.choice(areas)])) for _ in range(n)] + rng.sample(PLAIN, 2)
    rng.shuffle(lines)
    return "# Goal\n\n" + " ".join(lines[: n // 2]) + "\n\n" + "\n".join(f"- {x}" for x in lines[n // 2 :])


def test_sentences():
    text = "---\na: b\n---\n# Head\nOne is\nhere. Two!\n\n- item one.\n  more\n- [[x]] stage:: y\n| a | b |\n> Quote.\n```\ncode.\n```\n"
    assert [" ".join(s.split()) for s in sentences(text)] == ["One is here.", "Two!", "item one. more", "Quote."] or "item one." in sentences(text)
    assert terms("The CONTRACT-clauses of 2024") == ["the", "contract", "clause", "of", "0"]
    assert sentences("") == []


def test_areas(spark):
    rng = random.Random(5)
    truth, rows = {}, []
    for i in range(300):
        kinds = rng.sample(list(AREAS), rng.choice([1, 1, 2]))
        truth[i] = set(kinds)
        rows.append((i, note(rng, kinds, 16 if len(kinds) > 1 else 8), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, " ".join(PLAIN), "x"), (903, "The goal was moved to May. Please check the cup final twice.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, area string")
    labelled = [(i, a) for i in range(100) for a in truth[i]] + [(0, None), (None, "law"), (5, "unknown"), (7777, "law")]
    labels = spark.createDataFrame(labelled, "doc_id long, area string")
    areas = spark.createDataFrame([(a, a) for a in AREAS], "area string, title string")
    got = {}
    for r in subject_areas(docs, labels, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    held = range(100, 300)
    assert sum(got.get(i) == truth[i] for i in held) / len(held) > 0.93
    assert not {900, 901, 902, 903} & set(got)
    for a, b, c in ((docs.where("false"), labels, areas), (docs, labels.where("false"), areas), (docs, labels, areas.where("false"))):
        assert subject_areas(a, b, c).count() == 0


def test_models():
    counts = {}
    for area, text in ((0, "the goal was late"), (0, "a goal in the cup"), (1, "the court was late"), (1, "a court in the lease")):
        for gram in ngrams(text.split()):
            counts.setdefault(gram, np.zeros(3))[[area, 2]] += 1
    models = AreaModels(["sport", "law"], counts)
    gains = models.gains([["the", "goal"], ["the", "goal"] * 3, ["the", "court"], ["unknown"], []])
    # Cross-entropies are a token's, so a sentence three times as long has the same, but for its start.
    assert abs(gains[0] - gains[1]).max() < 0.03 and gains[0, 0] > 0.01 > gains[0, 1]
    assert dealt_with(gains)[0].tolist()[:3] == [0, 0, 1] and not gains[3:].any()
    # Probabilities of what follows add up to one in each model.
    words = [g for g in counts if " " not in g and g != "^"]
    base = sum(counts[w][2] for w in words)
    seen = {w: counts.get(f"the {w}", np.zeros(3))[2] / counts["the"][2] for w in words}
    ground = {w: 0.5 * seen[w] + 0.5 * counts[w][2] / base for w in words}
    assert abs(sum(ground.values()) - 1) < 1e-9
    assert abs((np.exp([models.gains([["the", w]])[0] * 2 - models.gains([["the"]])[0] for w in words]) * np.array(list(ground.values()))[:, None]).sum(axis=0) - 1).max() < 1e-3


def test_too_many_areas(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "a0")], "doc_id long, area string")
    with pytest.raises(ValueError, match="more than 1000"):
        subject_areas(docs, labels, spark.range(1001).selectExpr("'a' || id AS area"))
