"""Sections of Markdown texts: cleaned as a whole as line by line, parted in their own rows, each body cleaned once."""

import random

from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import sections
from weft.plans import catalog

PARTS = ["# ", "## ", "### x", "#### ", "\n", "\n", "\n\n\n", " ", "  ", "\t", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029", "> ", "- ", "* ", "+", "12. ", "3.", "**", "__", "`", "\\", "[", "_", "<PIC>", "<PIC:a.b>", "![x](y/z.png)", "w", "été", "字"]


def texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]


def test_whole_texts_are_cleaned_as_lines(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").select(F.regexp_replace("t", "\r\n?", "\n").alias("t")).union(spark.createDataFrame([(t,) for t in texts(100)], "t string"))
    by_line = F.array_join(F.transform(F.split("t", "\n"), tx.clean_markdown_line), "\n")
    got = df.select("t", tx.clean_markdown(F.col("t")).alias("a"), F.trim(by_line).alias("b")).collect()
    assert [(r["t"], r["a"]) for r in got] == [(r["t"], r["b"]) for r in got]


def test_parts_begin_at_heading_lines(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "product int, text string")
    lines = df.select("product", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line")).withColumn("mark", F.regexp_extract("line", sections.HEADING, 1))
    want: dict = {}
    for r in lines.orderBy("product", "pos").collect():
        parts = want.setdefault(r["product"], [(None, [])])
        if r["mark"]:
            parts.append((len(r["mark"]), []))
        else:
            parts[-1][1].append(r["line"])
    got: dict = {}
    for r in sections.bodies(df, "product", "text").orderBy("product", "part").collect():
        got.setdefault(r["product"], []).append((r["level"], r["raw"]))
    bare = lambda parts: [(level, raw) for level, raw in parts if level or raw]
    assert {k: bare(v) for k, v in got.items()} == {k: bare([(level, "\n".join(ls).strip(" ")) for level, ls in v]) for k, v in want.items()}


def test_heads_of_long_texts_make_the_same_summary(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choices(["<PIC>", " ", "\n", "a", "bc. "], [1, 4, 1, 2, 2], k=rng.randint(0, 900))),) for _ in range(200)] + [(" " * 2000 + "x" * 130,), ("x" * 126 + " " * 833 + "<PIC>",), (None,)]
    flat = tx.squeeze(F.replace("t", F.lit("<PIC>"), F.lit(" ")))
    want = F.when(F.length(flat) <= 120, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(120))), F.lit("...")))
    got = spark.createDataFrame(rows, "t string").select(tx.summary(F.col("t")).alias("a"), want.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_bodies_are_cleaned_once(spark):
    plan = catalog.QUERIES["markdown_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("{3,}") == 1
