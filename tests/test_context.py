"""Contexts, requests, conditions and node summaries against plain versions and hand-worked cases."""

import json
import random

from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.functions.excerpts import size
from weft.operators import context, contracts, evidence, lexical, media, routing, tree


def test_context_read_equals_a_plain_reading(spark):
    rng = random.Random(2)
    turns = [(s, t, " ".join(rng.choice(["pump", "型号", "leaks.", "not", "E-42"]) for _ in range(rng.randint(0, 60))), "answer " * rng.randint(0, 40)) for s in range(12) for t in range(rng.choice([1, 2, 5, 30, 140]))]
    turns += [(None, 1, "x", "y"), (50, 1, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn_id long, question string, answer string").repartition(5)
    made = [(s, min(t for x, t, _, _ in turns if x == s), max(t for x, t, _, _ in turns if x == s) - s % 2, "a summary") for s in range(0, 12, 3)]
    summaries = spark.createDataFrame(made, "conv_id long, first long, last long, content string")
    knobs = {"context": 2600, "recall": 400, "recent": 2, "recent_bytes": 900, "summary_bytes": 600}
    got = {r["session"]: r for r in context.context_read(df, summaries, **knobs).collect()}
    assert set(got) == {str(s) for s in {x for x, *_ in turns} - {None}}
    seen = set()
    for s in {x for x, *_ in turns} - {None}:
        own = [{"id": t, "question": q or "", "answer": a or ""} for x, t, q, a in sorted(turns, key=lambda r: (r[0] is None, r[0] or 0, r[1])) if x == s]
        fits = context.list_bytes(context.messages_of(own)) <= 2600 - 400 - context.INSTRUCTIONS
        summary = next((c for x, a, b, c in made if x == s and (a, b) == (own[0]["id"], own[-1]["id"])), None)
        want = context.composed(own, fits, summary, 2, 900, 600)
        row = got[str(s)]
        assert (row["method"], row["memory"], [m.asDict() for m in row["messages"]]) == want
        if not fits:
            assert sum(1 for _ in row["messages"]) <= 4 and size(row["memory"]) <= 700
        seen.add(row["method"])
    assert seen == {"exact", "rule_fallback", "model_summary"} or "budget_offload" in seen
    assert context.context_read(df.limit(0)).count() == 0


def test_results_keep_their_headers():
    text = "top\n[1] a | x\nsame body here\n[2] b | y\nsame body here\n[SECTION_FULL] c\nthe pump body\n[3] d\nother words " + "z" * 300 + "\n"
    out, repeats, left = contracts.compact_results(text, 60, "pump")
    assert (repeats, left) == (1, 4) and [h for h in ("[1] a | x", "[2] b | y", "[SECTION_FULL] c", "[3] d") if h in out] == ["[1] a | x", "[2] b | y", "[SECTION_FULL] c", "[3] d"]
    out, repeats, left = contracts.compact_results(text, size(text) - 150, "pump")
    assert left == 1 and "the pump body" in out and "zzz" not in out and contracts.REPEATED.format("[1] a | x") in out
    assert contracts.compact_results("plain " * 100, 200)[0].startswith("plain") and size(contracts.compact_results("plain " * 100, 200)[0]) <= 200


def test_condition_lists_stay_whole():
    text = "Use it as follows.\nOnly in the following cases:\n1. dry\n   and warm\n\n2) calm\nplain\nnever wet\n如果下列情况：\n2. no"
    assert context.condition_lines(text) == ["Only in the following cases:\n1. dry\n   and warm\n\n2) calm", "never wet", "如果下列情况："]
    assert context.qualifier_spans("a 3.5 b\nnot in  case") == [(0, 2, 5), (1, 8, 11), (1, 12, 20)] and context.condition_lines("") == []


def test_node_summaries():
    evidence_ = [{"leaf_id": "L", "quote": "the AB-12 was 没有 断电"}]
    good = {"id": "n", "text": "AB-12 未执行 断电", "sources": [{"leaf_id": "L", "quote": "AB-12 was 没有 断电"}]}
    check = lambda **x: context.node_summary_problems(good | x, evidence_, 200)
    assert check() == [] and check(text="AB-13") == ["fact"] and check(text="") == ["text"] and check(sources=[]) == ["sources"]
    assert check(text="AB-12 已执行 断电") == ["status"] and check(sources=[{"leaf_id": "M", "quote": "AB-12"}], text="AB-12") == ["quote"]
    assert context.node_summary_problems({"id": 1}, evidence_, 9) == ["keys"]


def test_tree_rendering_and_ablation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"word{i} told 型号 AB-{i}. " + "filler " * 30) for i in range(14)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = tree.session_trees(m).cache()
    q = spark.createDataFrame([(1, "word3 told")], "conv_id long, question string")
    picked = tree.collapsed(tree.searched(m, q), 3).withColumnRenamed("conv_id", "session")
    out = context.rendered_nodes(picked, budget=900).first()
    assert size(out["memory"]) <= 900 and 1 <= out["shown"] <= 3 and "[leaf=" in out["memory"] and "word3" in out["memory"]
    tops = nodes.filter("parent IS NULL").count()
    rest = context.without_roots(nodes)
    assert rest.count() == nodes.count() - tops and rest.filter("parent IS NULL").count() > tops
    linked = context.leaf_sources(nodes)
    assert linked.count() == nodes.selectExpr("explode(sources)").count() and linked.filter("turn_id IS NULL").count() == 0


def test_phrases_of_ideographs(spark):
    df = spark.createDataFrame([(1, "处理器单元 vs it"), (2, "x")], "k int, t string")
    got = {r["k"]: set(r["p"]) for r in df.select("k", lexical.phrases(F.col("t"), ["it"]).alias("p")).collect()}
    assert {"处理", "处理器单元", "器单元", "vs"} <= got[1] and "处理器单元 vs" not in got[1] and got[2] == set()
    held = spark.createDataFrame([("a", "处理器单元"), ("b", "单元"), ("a", "单元")], "owner string, p string")
    asked = df.select("k", F.explode(lexical.phrases(F.col("t"))).alias("p"))
    assert lexical.routed(asked, held, "k", "owner", least=5, lead=1).collect()[0]["weight"] == 5


def test_display_names_and_their_exclusions(spark):
    q = spark.createDataFrame([(1, "my phone is hot"), (2, "the cordless phone of my phone"), (3, "AirFryer!"), (4, "the airfryers"), (5, "空调不制冷"), (6, None)], "q int, question string")
    names = spark.createDataFrame([("Phone", "Phone", r"\bmy\s*phone", "cordless"), ("Air Fryer", "Air Fryer", None, None), ("空调手册", "空调", None, None), ("Empty", " ", None, None)], "product string, name string, unless string, but string")
    got = {(r["q"], r["product"]): r["length"] for r in routing.display_matches(q, names).collect()}
    assert got == {(2, "Phone"): 5, (3, "Air Fryer"): 8, (5, "空调手册"): 2}


def test_passages_and_bound_claims(spark):
    src = spark.createDataFrame([("k", 1, "  a b  "), ("k", 2, "x" * 2799 + " tail"), ("k", 3, None), ("j", 1, "p\n\n" + "q" * 2900)], "by string, id int, t string")
    cat = evidence.passages(src, "by", "id", "t").withColumnRenamed("id", "source_id")
    got = {(r["by"], r["passage"]): (r["source_id"], len(r["quote"])) for r in cat.collect()}
    assert got == {("k", "E1"): (1, 3), ("k", "E2"): (2, 2799), ("k", "E3"): (2, 4), ("j", "E1"): (1, 1), ("j", "E2"): (1, 2800), ("j", "E3"): (1, 100)}
    claims = spark.createDataFrame([("k", 1, ["E1", "E2"]), ("k", 2, ["E2", "E3"]), ("k", 3, ["E9"]), ("k", 4, ["E1", "E1"]), ("k", 5, [])], "by string, claim_id int, passage_ids array<string>")
    holds = {r["claim_id"]: (r["known"], r["one_each"]) for r in evidence.claims_hold(claims, cat, "by").collect()}
    assert holds[1] == (True, True) and holds[2] == (True, False) and not holds[3][0] and not holds[4][0] and not holds[5][0]
    assert [r["claim_id"] for r in evidence.bound_claims(claims, cat, "by").collect()] == [1]


def test_containing_finds_every_item(spark):
    docs = spark.createDataFrame([(1, "xx the longest word here yy"), (2, "the  longest word"), (3, "a b"), (4, None), (1, "xx the longest word here yy")], "d int, t string")
    items = spark.createDataFrame([(10, "e longest word h"), (11, "b"), (12, "absent words here too"), (13, None), (14, "  longest ")], "i int, s string")
    got = sorted((r["doc"], r["item"]) for r in lexical.containing(docs, items, "d", "t", "i", "s").collect())
    want = sorted((d["d"], i["i"]) for d in docs.collect() for i in items.collect() if d["t"] and i["s"] and i["s"] in d["t"])
    assert got == want and (1, 10) in got


def test_answers_and_captions(spark):
    df = spark.createDataFrame([(1, 70, "**A** <PIC> b <PIC>", ["x", "x", ""]), (2, 70, " ", []), (3, 1, "call 13812345678 [[PIC:z]]", None)], "k int, q int, a string, p array<string>")
    got = {r["k"]: r["s"] for r in df.select("k", tx.submission(F.col("q"), F.col("a"), F.col("p")).alias("s")).collect()}
    assert got == {1: 'A <PIC> b,["x"]', 2: tx.NO_ANSWER, 3: "call"}
    one = spark.createDataFrame([("f_000012.jpg",), ("bad",)], "n string")
    assert one.filter("n <> 'bad'").select(media.frame_time(F.col("n"), F.lit(2.0), F.lit(20.0))).first()[0] == 20.0
