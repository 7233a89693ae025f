"""Tool texts read by lines, worked by hand."""

from weft.operators import observations as ob

TEXT = """[SEARCH_STATUS] ok
[SEARCH_FILTERED] 3
[SEARCH_STATUS] no_result
[1] 产品: Fan A | 章节: Care / Clean
上层章节ID: 12
上层摘要: how to: clean
内容: first line
  second 内容: line  

last [2] 产品
图片内容标注（x）
[2] 产品: Fan B | 章节: Start
no content here
[SECTION_FULL] 产品: Fan B | 章节ID: 7 | 章节: Whole
完整章节正文:

body <PIC:p1>
产品: Fan C
章节: [4] Other"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "q long, text string, stated string")


def test_hits(spark):
    got = {r["rank"]: r for r in ob.hits(frame(spark, [(1, TEXT, None)]), "q", "text").collect() if r["product"] != "-"}
    assert sorted(got) == [1, 2, 3]
    assert tuple(got[1])[2:7] == ("Fan A", "Care / Clean", "12", "how to: clean", "first line\n  second 内容: line\n\nlast [2] 产品")
    assert tuple(got[2])[2:7] == ("Fan B", "Start", None, None, None)
    assert tuple(got[3])[2:5] == ("Fan B", "Whole", "7") and got[3]["content"] == "body <PIC:p1>\n产品: Fan C\n章节: [4] Other"


def test_observed(spark):
    rows = [(1, TEXT, "Fan A"), (2, None, "x"), (3, "  ", None), (4, "(无检索结果)", None), (5, "未找到 x", None), (6, "[SEARCH_STATUS] no_result\n[SEARCH_REASON] empty index", None)]
    rows += [(7, "[1] 产品: B | 章节: h\n[2] 产品: A | 章节: h\n[3] 产品: A | 章节: h\n[4] 产品: B | 章节: h", "A"), (8, "[1] 产品: B | 章节: h", "A"), (9, "产品: B\n产品: B", "B"), (10, "[SEARCH_FILTERED] many\nplain", None)]
    got = {r["q"]: tuple(r)[1:] for r in ob.observed(frame(spark, rows), "q", "text", "stated").collect()}
    assert got[1] == ("ok", None, 3, False, 3, 3, "Fan A", 1, False)
    for q in (2, 3, 4, 5):
        assert got[q] == (None, None, None, True, 0, 0, None, 0, False)
    assert got[6][:4] == ("no_result", "empty index", None, True)
    assert got[7][6:] == ("B", 2, True)  # of equal ones the first named; the product asked for is another
    assert got[8][6:] == ("B", 1, False)  # one line is too little for a conflict
    assert got[9][4:] == (2, 0, "B", 2, False)
    assert got[10][2:4] == (None, False)


def test_round_trip(spark):
    rows = [(1, k, f"P{k % 3}", f"h {k}", str(40 + k), f"text {k}\n\nmore | 章节: x") for k in range(1, 12)] + [(2, 1, "P", "h", "1", "")]
    hits = spark.createDataFrame(rows, "q long, rank long, product string, heading string, section_id string, content string")
    back = ob.hits(ob.rendered(hits, "q"), "q", "text").select("q", "rank", "product", "heading", "section_id", "content")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_empty_table(spark):
    none = frame(spark, []).filter("false")
    assert ob.hits(none, "q", "text").count() == ob.observed(none, "q", "text").count() == 0
