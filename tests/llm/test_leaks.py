from corvane.llm.leaks import bare, best_window, find_leaks, openings, remove_leaks, tokens

ITEM = "Read this and answer. " + " ".join(f"word{c}{d}" for c in "abcdef" for d in "uvwxyz")
W = ITEM.split()[4:]


def noisy(words):
    return "> <b>" + words[0].upper() + "</b>&nbsp;" + "​".join(words[1]) + " **" + words[2] + "**^5 [12] " + words[3] + ",\n> " + " ".join(words[4:])


def test_tokens():
    assert tokens("1. It’s &eacute;t&eacute; <i>a</i>b [3] c^4 **d**e f\xadg x-\ny") == ["it", "s", "ete", "ab", "c", "de", "fg", "xy"]
    assert len(bare("a &amp; b <br> ^7 x")) == len("a &amp; b <br> ^7 x")


def test_window():
    import numpy as np

    same = np.array([True] * 24)
    same[[3, 10, 17]] = False
    assert best_window(same, 15, 24, 7) == (0, 23)
    same[20] = False
    assert best_window(same, 15, 24, 7) is None
    assert best_window(np.array([False] + [True] * 15 + [False]), 15, 24, 7) == (1, 15)
    assert best_window(np.array([True] * 14), 15, 24, 7) is None


def altered(words, every):
    return ["odd" if k % every == every - 1 else w for k, w in enumerate(words)]


def docs_and_items(spark):
    texts = {
        1: "Before. " + noisy(W[5:20]) + " after", 2: " ".join(W[5:19]), 3: " ".join(altered(W[:24], 7)), 4: " ".join(altered(W[:24], 5)), 5: None, 6: "", 7: "Read this and answer. " + " ".join(W[:12]),
        8: "Read this and answer. " * 10, 9: "x " * 50_000 + " ".join(W),
    }
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(1, texts[1], 1)], "doc_id long, text string, item_id long")
    items = [(1, ITEM), (1, ITEM), (2, "Read this and answer. Something else entirely."), (3, "Read this and answer. Other words again."), (None, "x " * 30), (4, None), (5, "")]
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_find(spark):
    docs, items = docs_and_items(spark)
    skips = {r.text: r.skip for r in openings(items.where("text IS NOT NULL").select("item_id", "text").distinct()).collect()}
    assert skips == {r.text: 4 if r.text.startswith("Read") else 0 for r in items.collect() if r.text is not None}
    for slice_words in (2_000_000, 10):
        got = find_leaks(docs, items, slice_words=slice_words).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 1), (3, 1), (9, 1)]
        assert {r.doc_id: r.altered for r in got} == {1: 0, 3: 3, 9: 0}
    assert find_leaks(docs.where("false"), items).count() == 0 and find_leaks(docs, items.where("false")).count() == 0


def test_remove(spark):
    docs, items = docs_and_items(spark)
    docs = docs.dropDuplicates(["doc_id"])
    clean = {r.doc_id: r.text for r in remove_leaks(docs, items).collect()}
    assert clean[1].startswith("Before. ") and clean[1].endswith(" after") and "word" not in clean[1].lower()
    assert clean[2] == " ".join(W[5:19]) and clean[5] is None and len(clean) == 9


def test_shifted(spark):
    words = [f"{w}'s" if k % 8 == 3 else w for k, w in enumerate(W)]
    other = lambda *at: " ".join("odd" if k in at else w for k, w in enumerate(words[:24]))
    texts = {
        1: other(3, 11, 19), 2: other(3, 7, 11, 19), 3: other(0, 11, 19), 4: " ".join([*words[:8], "odd", *words[8:16], *words[17:26]]), 5: " ".join([*words[:12], "an", "odd", "pair", *words[12:23]]),
        6: " ".join(words[:11]) + " odd text in between, at some length, so that nothing goes on here " + " ".join(words[13:24]), 7: other(3, 11) + " 'odd'",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in find_leaks(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 3, 4, 5, 7] and got[1].altered == 3 and got[7].altered == 2
    assert (got[1].first_char, got[1].last_char) == (0, len(texts[1])) and got[7].last_char == len(other(3, 11))


def test_all_passages(spark):
    texts = {
        1: " ".join(W[:30]) + " middle " + " ".join(W[:20]) + " end", 2: "start " + " ".join(W[:16]) + " middle" * 60 + " " + " ".join(W[16:32]),
        3: "start " + " ".join(W[15:32]) + " middle " + " ".join(W[:15]), 4: " ".join(W[:20]) + " odd pair " + " ".join(W[20:29]) + " middle " * 9 + " ".join(W[:14]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(W))], "item_id long, text string")
    assert sorted((r.doc_id, r.words) for r in find_leaks(docs, items).collect()) == [(1, 20), (1, 30), (2, 16), (2, 16), (3, 15), (3, 17), (4, 31)]
    clean = {r.doc_id: r.text.split() for r in remove_leaks(docs, items).collect()}
    assert clean == {1: ["middle", "end"], 2: ["start"] + ["middle"] * 60, 3: ["start", "middle"], 4: ["middle"] * 9 + W[:14]}


def test_nothing_is_left(spark):
    other = [f"other{k}" for k in range(40)]
    texts = {
        1: " ".join(W[:20] + W[:30]), 2: " ".join(W[:18] + ["an", "odd", "insert"] + W[18:]), 3: " ".join(W[:12] + other[:20] + W[12:24]), 4: " ".join(W) + "\n" + " ".join(other) + " " + " ".join(W), 5: None, 6: "",
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(None, texts[1], "x"), (6, "", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(W)), (2, " ".join(other)), (2, " ".join(W[::-1]))] + [(k, f"item {k} " + " ".join(f"v{k}x{i}" for i in range(20))) for k in range(10, 40)], "item_id long, text string")
    for slice_words in (2_000_000, 20):
        clean = remove_leaks(docs, items, slice_words=slice_words)
        assert find_leaks(clean, items).count() == 0
        got = sorted((r.doc_id or 0, r.text) for r in clean.collect() if r.text is not None)
        assert len(got) == 7 and [t.split() for _, t in got] == [[], [], [], [], [], [], []] and clean.where("text IS NULL").count() == 1
    assert remove_leaks(docs.where("false"), items).count() == 0 and remove_leaks(docs, items.where("false")).count() == 8
