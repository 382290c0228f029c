from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.split import SENTENCE_END, blocks, cut, split_oversized, tokens

TEXT = """Para one
still one

- a
  more of a
- b
Para two
| x |
| y |
> q
```py
in code

| no table |
~~~
```
1. one
* two"""


def test_blocks():
    lines = [n for _, n in blocks(TEXT)[0]]
    assert lines == [0, 3, 6, 7, 9, 10, 16]
    assert [n for _, n in blocks("~~~\nopen\n\nto the end\n- no list")[0]] == [0]
    assert [n for _, n in blocks("a\r\n\r\nb\r\n \t\r\nc")[0]] == [0, 2, 4]
    assert [n for _, n in blocks("````\n```\n````\n*emphasis* here")[0]] == [0, 3]
    assert blocks("")[0] == []


WORDS = st.lists(st.sampled_from(["a", "bb", "c.", "\n", "\n\n", "- x\n", "| y |\n", "```\n", " "]), max_size=300)


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_pieces_hold_all_words(parts):
    text = " ".join(parts)
    words = text.split()
    pieces = cut(text, 5, 20, 4)
    kept = []
    for k, p in enumerate(pieces):
        own = p["text"].split()
        assert len(own) == p["words"] <= 20
        if k:
            assert own[:4] == kept[-4:]
        kept += own[4:] if k else own
        assert p["line_start"] >= 5
    assert kept == words
    assert sorted(n for p in pieces for n in p["block_lines"]) == [5 + n for _, n in blocks(text)[0]]


def test_cut_prefers_blocks():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(15)) for _ in range(4))
    assert [p["words"] for p in cut(text, 1, 40, 5)] == [30, 35]
    assert [p["words"] for p in cut("x " * 100, 1, 40, 5)] == [40, 40, 30]
    assert [len(p["text"]) for p in cut("y" * 10_000, 1, 40, 5)] == [4000, 4000, 3000]
    assert "".join(p["text"][500 * (k > 0) :] for k, p in enumerate(cut("xyz" * 3_333, 1, 40, 5))) == "xyz" * 3_333


def by_hand(text, limit, overlap):
    """(first, last) token of each piece, found by trying every place from the limit down."""
    spans = tokens(text)
    starts_block = {text[: o].split().__len__() for o, _ in blocks(text)[0]}
    starts_line = {len(text[:o].split()) for o in blocks(text)[1]}
    out, done = [], 0
    while done < len(spans):
        begin = max(0, done - overlap) if out else 0
        most = min(len(spans), begin + limit)
        ends = [most] if most == len(spans) else []
        for good in (lambda e: e in starts_block, lambda e: e in starts_line, lambda e: bool(SENTENCE_END.search(text[slice(*spans[e - 1])])), lambda e: e == most):
            ends = ends or [e for e in range(most, done, -1) if good(e)][:1]
        out.append((begin, ends[0]))
        done = ends[0]
    return out


@settings(max_examples=60, deadline=None)
@given(WORDS, st.integers(3, 30))
def test_cut_against_trying(parts, limit):
    text = " ".join(parts)
    spans = tokens(text)
    want = [(len(text[slice(spans[a][0], spans[b - 1][1])].split()), text[spans[a][0] : spans[b - 1][1]]) for a, b in by_hand(text, limit, 2)]
    assert [(p["words"], p["text"].lstrip()) for p in cut(text, 1, limit, 2)] == want


def test_operator(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "H", 3, long, "x"), (1, "H", 3, long, "x"), (2, None, None, long, "x"), (3, "H", 1, None, "x"), (4, "H", 1, "", "x"), (5, "H", 1, "few", "x"), (None, "H", 1, long, "x"), (None, "H", 1, long + " z", "x")]
    rows.append((9, "H", 4, "z" * 5000, "x"))
    df = spark.createDataFrame(rows, "id long, heading_path string, line_start int, text string, words string")
    got = split_oversized(df, 20, 4).collect()
    assert {r.chunk_id for r in got} == {1, 2, 9, None}
    assert [len(r.text) for r in sorted((r for r in got if r.chunk_id == 9), key=lambda r: r.piece_no)] == [2000, 2000, 1800]
    assert [r.piece_no for r in sorted((r for r in got if r.chunk_id == 1), key=lambda r: r.piece_no)] == [0, 1, 2]
    assert all(r.line_start is None and r.block_lines == [] for r in got if r.chunk_id == 2)
    assert split_oversized(df.where("false"), 20, 4).count() == 0
