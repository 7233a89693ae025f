"""Pictures of chunks against slicing and counting."""

import random

from weft.operators import anchors, chunking
from weft.plans import catalog


def sliced(text, names, a, b):
    """The names of the marks that lie wholly in text[a:b]: those that begin before it are counted, those inside are cut out."""
    before = text[: a + len(anchors.MARK) - 1].count(anchors.MARK)
    return [x for x in names[before : before + text[a:b].count(anchors.MARK)] if x is not None]


def texts(n=60):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        parts = [rng.choice(["word ", "句子。", "a. ", "\n\n", anchors.MARK, anchors.MARK, "<PI", "C>", "é, "]) for _ in range(rng.randint(0, 400))]
        text = "".join(parts)
        marks = text.count(anchors.MARK)
        rows.append((i, text, [f"p{i}_{k}" if k % 7 else None for k in range(rng.choice([marks, marks // 2, marks + 3, 0]))]))
    long = ("filler text. " * 30 + anchors.MARK) * 60
    return [*rows, (900, long, [f"q{k}" for k in range(60)]), (901, None, ["x"]), (902, anchors.MARK, None), (903, "", ["x"])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string, names array<string>")


def check(spark, rows, cut, width=anchors.WIDTH):
    df = frame(spark, rows)
    chunks = chunking.spans(df.select("doc", "text"), "text", cut)
    found = anchors.anchors(df, "doc", "text", "names")
    got = anchors.chunk_pictures(chunks, found, "doc", "chunk", width=width).collect()
    by = {doc: (text, names or []) for doc, text, names in rows}
    assert len(got) == chunks.count() and any(r["pics"] for r in got)
    for r in got:
        assert r["pics"] == sliced(*by[r["doc"]], r["start"], r["end"]), r
    return got


def test_sentence_windows_that_overlap(spark):
    got = check(spark, texts(), chunking.sliding)
    seen = [x for r in got for x in r["pics"]]
    assert len(seen) > len(set(seen))  # shared by chunks that overlap


def test_fixed_windows_cut_marks(spark):
    check(spark, texts(), lambda t: [(a, min(a + 37, len(t))) for a in range(0, len(t), 20)], width=16)


def test_whole_texts_take_every_named_mark(spark):
    got = check(spark, texts(), lambda t: [(0, len(t))], width=64)
    assert [len(r["pics"]) for r in got if r["doc"] == 900] == [60]


def test_positions(spark):
    df = frame(spark, [(1, "é<PIC><PIC>x<PIC>", ["a", None, "c"]), (2, "<PIC>", ["a", "b"]), (3, None, ["a"]), (4, "<PIC>", None)])
    got = sorted(tuple(r) for r in anchors.anchors(df, "doc", "text", "names").collect())
    assert got == [(1, 0, 1, 6, "a"), (1, 2, 12, 17, "c"), (2, 0, 0, 5, "a")]


def test_empty_spans_and_tables(spark):
    df = frame(spark, [(1, "<PIC>", ["a"])])
    found = anchors.anchors(df, "doc", "text", "names")
    chunks = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 5), (2, 0, 0, 5)], "doc long, chunk int, start int, end int")
    got = {(r["doc"], r["chunk"]): r["pics"] for r in anchors.chunk_pictures(chunks, found, "doc", "chunk").collect()}
    assert got == {(1, 0): [], (1, 1): ["a"], (2, 0): []}
    assert anchors.chunk_pictures(chunks.filter("false"), found, "doc", "chunk").count() == 0
    assert anchors.chunk_pictures(chunks, found.filter("false"), "doc", "chunk").count() == 3


def test_sizes_of_pieces_from_running_counts():
    for _, t, _ in texts():
        size = chunking.Units(t or "")
        for a in range(0, len(t or ""), 7):
            assert all(size.of(a, b) == chunking.units(t[a:b]) for b in (a, a + 1, a + 4, a + 30, len(t)) if a <= b <= len(t))


def test_texts_are_cut_and_marked_in_one_pass_each(spark):
    plan = catalog.QUERIES["sentence_pictures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Window" not in plan


def test_sentence_ends_as_written_out():
    import random
    import re
    import sys

    plain = re.compile(r"\n{2,}|[。！？!?；;]\s*|[:：]\s+|\.\s+|\n")
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choices("\n.:：；! a\t 　", k=rng.randint(0, 30)))
        assert [m.span() for m in plain.finditer(t)] == [m.span() for m in chunking._BREAK.finditer(t)]
    assert not any(chr(i).isspace() for i in range(0x3001, sys.maxunicode + 1))
