"""The rule engine and the expansion of scenes on small tables."""

import pytest
from pyspark.sql import functions as F

from weft.operators import expansion, rules

RULES = [
    ("close lid", "question", 1, "how"), ("close lid", "source", 1, "close the lid"), ("close lid", "claim", 1, "close"), ("close lid", "claim", 1, "shut"), ("close lid", "claim", 2, "lid"), ("close lid", "never", 1, "need not"),
    ("water", "source", 1, "hot water"), ("water", "source", 2, "50"), ("water", "claim", 1, "50"),
]
RULE = "rule string, part string, grp int, phrase string"


def omitted(spark, claims, question="How do I wash?", part_bytes=rules.PART_BYTES, sources=None):
    answers = spark.createDataFrame([(1, question), (None, "how")], "answer long, question string")
    sources = sources or [(1, 7, "To avoid splashes, CLOSE the-lid."), (1, 8, "Don't use hot water (50°C)."), (1, 9, None), (None, 3, "close the lid")]
    s = spark.createDataFrame(sources, "answer long, source long, text string")
    c = spark.createDataFrame(claims, "answer long, claim long, text string, cited array<long>")
    return sorted((r["rule"], r["source"], r["sources"]) for r in rules.omissions(answers, s, c, spark.createDataFrame(RULES, RULE), part_bytes).collect())


def test_omissions(spark):
    both = [("close lid", 7, 1), ("water", 8, 1)]
    assert omitted(spark, []) == both
    assert omitted(spark, [(1, 1, "Then shut the lid. Stay below 50 degrees.", None)]) == []
    assert omitted(spark, [(1, 1, "Shut the tap. The lid is red.", None)]) == both  # not in one sentence
    assert omitted(spark, [(1, 1, "You need not close the lid!", [7, 8])]) == both
    assert omitted(spark, [(1, 1, "close the lid at 50", [8])]) == [("close lid", 7, 1)]  # cites another source
    assert omitted(spark, [(1, 1, "closely lidded, 500", None), (2, 1, "close lid 50", None), (None, 1, "close lid", None), (1, 2, None, None)]) == both


def test_question_part_and_least_anchor(spark):
    assert omitted(spark, [], question="What is it?") == [("water", 8, 1)]
    assert omitted(spark, [], question=None) == [("water", 8, 1)]
    twice = [(1, 12, "close the lid"), (1, 11, "now close the lid."), (1, 11, "now close the lid.")]
    assert omitted(spark, [], sources=twice) == [("close lid", 11, 2)]


def test_phrases_in_parts_give_the_same(spark):
    for claims in ([], [(1, 1, "shut the lid. 50", None)]):
        assert omitted(spark, claims, part_bytes=8) == omitted(spark, claims)


def test_found_is_by_words(spark):
    texts = spark.createDataFrame([(1, "a b a b a"), (2, "AB-a"), (3, None), (4, ""), (5, "x" * 100_000 + " a")], "id long, text string")
    phrases = spark.createDataFrame([(" a ",), (" b a ",), (" ab a ",), ("  ",)], "phrase string")
    got = sorted((r["id"], r["phrase"].strip()) for r in rules.found(texts, "text", phrases).collect())
    assert got == [(1, "a"), (1, "b a"), (2, "a"), (2, "ab a"), (5, "a")]
    assert rules.found(texts, "text", phrases.limit(0)).count() == 0


def test_broken_rules_raise(spark):
    answers, sources = spark.createDataFrame([(1, "q")], "answer long, question string"), spark.createDataFrame([(1, 1, "x")], "answer long, source long, text string")
    claims = spark.createDataFrame([], "answer long, claim long, text string, cited array<long>")
    for bad in (("r", "other", 1, "x"), ("r", "source", 1, "?!"), (None, "source", 1, "x")):
        with pytest.raises(ValueError, match="rule rows"):
            rules.omissions(answers, sources, claims, spark.createDataFrame([bad, ("r", "source", 1, "x")], RULE)).collect()


def test_first_rule_in_order(spark):
    rows = [("a", "claim", 1, "lid"), ("b", "claim", 1, "close"), ("b", "never", 1, "not"), ("c", "claim", 1, "tap")]
    order = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "rule string, rule_order int")
    texts = spark.createDataFrame([(1, "Close the lid."), (2, "Do not close the lid."), (3, "The tap."), (4, "nothing"), (None, "lid")], "id long, text string")
    got = {r["id"]: r["rule"] for r in rules.first_rules(texts, "id", "text", spark.createDataFrame(rows, RULE), order).collect()}
    assert got == {1: "b", 2: "a", 3: "c"}


FRAMES = [("f1", "s", 1, 0.5, "one"), ("f2", "s", 1, 1.5, "two two"), ("f3", "s", 1, 1.5, "three"), ("g1", "t", 1, 12.0, "short")]
FRAME = "frame string, scene string, record long, at double, text string"


def text_of(*lines):
    return "\n".join([expansion.HEAD, *lines])


SCENES = [("s", 1, 0.0, 10.0, text_of("[0.500] one", "[1.500] two two", "[1.500] three")), ("t", 1, 10.0, 20.0, text_of("[12.000] short")), ("u", 2, 0.0, 1.0, expansion.HEAD)]
SCENE = "scene string, record long, start double, end double, text string"


def pieces(spark, cap=40, frames=FRAMES, scenes=SCENES):
    return {r["id"]: r for r in expansion.expanded(spark.createDataFrame(scenes, SCENE), spark.createDataFrame(frames, FRAME), cap).collect()}


def test_scenes_in_pieces(spark):
    got = pieces(spark)
    assert {i: (r["kind"], r["parent"], r["piece"], r["pieces"], r["frames"]) for i, r in got.items()} == {
        "s": ("parent", None, None, None, 3), "s-0001": ("piece", "s", 1, 2, 2), "s-0002": ("piece", "s", 2, 2, 1), "t": ("scene", None, None, None, 1), "u": ("scene", None, None, None, 0),
    }
    assert got["s-0001"]["text"] == text_of("[0.500] one", "[1.500] two two") and got["s-0002"]["text"] == text_of("[1.500] three")
    assert "\n".join([got["s-0001"]["text"], *got["s-0002"]["text"].split("\n")[1:]]) == got["s"]["text"]
    assert all(r["kind"] != "piece" for r in pieces(spark, cap=70).values())
    assert [r["frames"] for i, r in sorted(pieces(spark, cap=5).items()) if r["kind"] == "piece"] == [1] * 4  # a frame is never cut


@pytest.mark.parametrize(
    "frames, scenes, problem",
    [
        ([*FRAMES[:1], ("f2", "s", 1, 1.5, "two TWO"), *FRAMES[2:]], SCENES, "make up"),
        ([FRAMES[0], *FRAMES[2:]], SCENES, "make up"),
        ([*FRAMES, ("f4", "s", 1, 2.0, "more")], SCENES, "make up"),
        ([*FRAMES, FRAMES[3]], [*SCENES[:1], ("t", 1, 10.0, 20.0, text_of("[12.000] short", "[12.000] short")), SCENES[2]], "make up"),
        ([*FRAMES, ("g2", "t", 1, 25.0, "late")], SCENES, "outside"),
        ([*FRAMES[:3], ("g1", "t", 2, 12.0, "short")], SCENES, "outside"),
        ([*FRAMES, ("x", "unknown", 1, 0.0, "x")], SCENES, "outside"),
        (FRAMES, [*SCENES, ("s-0001", 2, 0.0, 1.0, expansion.HEAD)], "twice"),
        (FRAMES, [SCENES[0], SCENES[1], ("u", 2, 0.0, 1.0, "Frames: tampered")], "make up"),
        (FRAMES, [*SCENES, (None, 2, 0.0, 1.0, expansion.HEAD)], "without an id"),
    ],
)
def test_tampered_scenes_raise(spark, frames, scenes, problem):
    with pytest.raises(Exception, match=problem):
        pieces(spark, frames=frames, scenes=scenes)


def test_no_scenes(spark):
    assert pieces(spark, frames=[], scenes=[]) == {}


def test_packing_is_greedy(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), ((F.col("id") * 7919) % 50 + 1).alias("n"))
    got = {(r["k"], r["o"]): r["piece"] for r in expansion.packed(rows, "k", "o", "n", 60).collect()}
    for k in range(3):
        piece = used = 0
        for o in range(k, 200, 3):
            n = o * 7919 % 50 + 1
            piece, used = (piece, used + 1 + n) if piece and used + 1 + n <= 60 else (piece + 1, n)
            assert got[k, o] == piece
