"""Coverage of gold sources by ways to keep memory, worked by hand."""

from pyspark.sql import functions as F

from weft.operators import coverage

TURNS = [
    (1, 0, "the valve sticks at noon", "oil it"),
    (1, 1, "x" * 300, "long"),
    (1, 2, "fan hums", "clean"),
    (2, 0, "only turn", None),
    (3, 0, None, None),
]


def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn_id long, question string, answer string")


def shown(df):
    return sorted((r["conv_id"], -1 if r["turn_id"] is None else r["turn_id"], r["base"]) for r in df.collect())


def test_windows(spark):
    t = turns(spark)
    assert shown(coverage.whole(t, "conv_id")) == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, True), (3, 0, True)]
    assert shown(coverage.window(t, "conv_id", 150)) == [(1, 2, True), (2, 0, True), (3, 0, True)]
    assert shown(coverage.fitting(t, "conv_id", 150)) == [(1, 0, True), (1, 2, True), (2, 0, True), (3, 0, True)]  # the long turn is skipped


def test_recall_adds_turns_outside_the_window(spark):
    asked = spark.createDataFrame([(1, "does the valve stick?"), (2, "only"), (3, None)], "conv_id long, q string")
    got = shown(coverage.recalled(turns(spark), asked, "conv_id", 150))
    assert got == [(1, 0, False), (1, 2, True), (2, 0, True), (3, 0, True)]


def test_rolling_shows_the_summary_and_the_newest(spark):
    rows = coverage.rolled(turns(spark), "conv_id", 1, 1, 200)
    assert shown(rows) == [(1, -1, True), (1, 2, True), (2, 0, True), (3, 0, True)]
    text = rows.filter("conv_id = 1 AND turn_id IS NULL").first()["text"]
    assert text.startswith("[turn=0] the valve sticks at noon\n[turn=1] xxx") and len(text.encode()) <= 200


def pieces(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn_id long, text string, base boolean")


def test_cases_and_counters(spark):
    gold = spark.createDataFrame([(1, 0, "valve sticks"), (2, 0, ""), (3, 4, "absent"), (4, 1, "far")], "conv_id long, turn_id long, quote string")
    ways = {
        "a": pieces(spark, [(1, 0, "the  valve\nsticks", False), (1, 2, "valve sticks", True), (2, 0, "only", True), (4, 1, "so far " + "." * 90, True), (9, 0, "no gold", True)]),
        "b": pieces(spark, [(1, None, "[turn=0] the valve sticks", True), (1, None, None, True), (3, 5, "absent", True)]),
    }
    rows = coverage.cases(gold, ways, "conv_id", 50)
    got = {(r["strategy"], r["conv_id"]): (r["covered"], r["memory_covered"], r["pieces"], r["problem"]) for r in rows.collect()}
    assert got == {
        ("a", 1): (True, False, 2, None),  # white space counts as one blank; the memory's piece is of another turn
        ("a", 2): (False, False, 1, "quote"),
        ("a", 3): (False, False, 0, "not visible"),
        ("a", 4): (True, True, 1, "budget"),
        ("b", 1): (True, True, 2, None),  # a piece without a turn may show any
        ("b", 2): (False, False, 0, "quote"),
        ("b", 3): (False, False, 1, "not visible"),  # said in another turn
        ("b", 4): (False, False, 0, "not visible"),
    }
    counts = {r["strategy"]: tuple(r)[1:7] for r in coverage.counters(rows, 50).collect()}
    assert counts == {"a": (4, 2, 1, 3, 1, 4), "b": (4, 1, 1, 4, 1, 3)}


def test_nothing_at_all(spark):
    gold = spark.createDataFrame([(1, 0, "q")], "conv_id long, turn_id long, quote string")
    none = pieces(spark, [])
    assert coverage.cases(gold.filter("false"), {"a": none}, "conv_id", 9).count() == 0
    assert coverage.cases(gold, {"a": none}, "conv_id", 9).first()["problem"] == "not visible"


def test_trees(spark):
    rows = spark.createDataFrame(
        [(1, "1", None, 1, None, "root", 0.1, True), (1, "1.1", "1", 0, 0, "leaf a", 0.9, True), (1, "1.2", "1", 0, 1, "leaf b", 0.2, True)],
        "conv_id long, node string, parent string, level int, turn_id long, text string, score double, known boolean",
    )
    got = {k: sorted(r["text"] for r in v.collect()) for k, v in coverage.trees(rows, k=1).items()}
    assert got == {"collapsed": ["leaf a"], "traversal": ["leaf a", "root"]}
    assert not any(r["base"] for v in coverage.trees(rows).values() for r in v.collect())


def test_turns_are_read_as_given(spark):
    """Other columns, with names that the operator uses itself, don't matter."""
    t = turns(spark).withColumn("text", F.lit("other")).withColumn("base", F.lit(3))
    assert shown(coverage.window(t, "conv_id", 150)) == shown(coverage.window(turns(spark), "conv_id", 150))
