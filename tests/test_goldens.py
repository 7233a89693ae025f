"""Small literal cases with results worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import chunking, evidence, lexical, ranking, sections, sessions, timeline, tree, vectors
from weft.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scene_tokens_expand_ideograph_pairs(spark):
    assert one(spark, tx.scene_tokens(F.lit("Model X-200 更换电池 a.b/c"))) == ["model", "x-200", "更换电池", "更换", "换电", "电池", "a.b/c"]
    assert one(spark, tx.scene_tokens(F.lit(""))) == []
    assert one(spark, tx.scene_tokens(F.lit(None).cast("string"))) == []


def test_session_and_citation_terms(spark):
    assert one(spark, tx.session_terms(F.lit("A ab AB x_1 电池盒"))) == ["ab", "x_1", "电池", "池盒"]
    assert one(spark, tx.citation_tokens(F.lit("[E1] the cat at cat"), ["the"])) == ["cat"]


def test_latin_tokens_add_bare_form_first(spark):
    assert one(spark, tx.latin_tokens(F.lit("Use safety@ gear, gear"))) == ["use", "safety", "safety@", "gear"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a b d d")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "b b d")], "query_id long, text string")
    t = tx.scene_tokens(F.col("text"))
    got = {r["doc"]: r["score"] for r in lexical.bm25(docs, q, t, t).collect()}
    w = {x: math.log(3 - n + 0.5) - math.log(n + 0.5) for x, n in {"a": 3, "b": 2, "c": 1, "d": 1}.items()}
    mean = sum(w.values()) / 4
    idf = {x: v if v >= 0 else 0.25 * mean for x, v in w.items()}
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 3))
    assert got[1] == pytest.approx(2 * idf["b"] * part(1, 3))
    assert got[3] == pytest.approx(2 * idf["b"] * part(1, 4) + idf["d"] * part(2, 4))
    assert 2 not in got


def test_top_k_ties_nan_and_k(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("nan")), (1, 2, 2.0), (1, 3, 1.0), (1, 4, float("-inf"))], "q int, pos int, s double")
    order = lambda k: [r["pos"] for r in ranking.top_k(df, ["q"], "s", "pos", k).orderBy("rank").collect()]
    assert order(2) == [2, 0]
    assert order(9) == [2, 0, 3, 1, 4]
    assert order(0) == []


def test_rrf_modes(spark):
    r = spark.createDataFrame([(1, 1, 2, 3)], "id int, bm25_rank int, dense_rank int, visual_rank int")
    assert ranking.rrf(r, "tri_hybrid").first()["score"] == pytest.approx(0.3 / 61 + 0.35 / 62 + 0.35 / 63)
    assert ranking.effective_mode("tri_hybrid", True, False) == "hybrid"
    assert ranking.effective_mode("visual", True, False) == "bm25"
    with pytest.raises(ValueError):
        ranking.effective_mode("hybrid", False, False, strict=True)


def test_cap_equals_greedy_loop(spark):
    rng = random.Random(5)
    items = [(0, i, rng.randint(0, 4), rng.randint(0, 6) / 2) for i in range(60)]
    df = spark.createDataFrame(items, "q int, doc int, rec int, s double")
    got = [r["doc"] for r in ranking.capped(df, ["q"], "rec", "s", "doc", 2, 7).orderBy("rank").collect()]
    seen, want = {}, []
    for _, doc, rec, _ in sorted(items, key=lambda x: (-x[3], x[1])):
        if seen.get(rec, 0) < 2 and len(want) < 7:
            seen[rec] = seen.get(rec, 0) + 1
            want.append(doc)
    assert got == want


def test_ordered_union_first_wins(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, pos int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, d string, pos int")
    assert [r["d"] for r in ranking.ordered_union([a, b], ["q"], "d", "pos", 2).orderBy("rank").collect()] == ["x", "y"]


def test_votes_count_a_section_once(spark):
    df = spark.createDataFrame([(1, "p", 1, 1), (1, "p", 1, 2), (1, "q", 1, 3), (1, "p", 2, 9)], "q int, product string, section int, rank int")
    assert {r["product"]: r["votes"] for r in ranking.rank_votes(df, ["q"], "section", "product", "rank").collect()} == {"p": 5, "q": 3}


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 10, 1, 0), (1, 11, 2, 1), (2, 12, 1, 0)], "q int, d int, rank int, gain int")
    got = {r["q"]: r for r in ranking.graded(ranks, ["q"], "gain", "rank", ranks).collect()}
    assert got[1]["mrr"] == 0.5 and got[1]["recall"] == 1.0 and got[1]["ndcg"] == pytest.approx(1 / math.log2(3))
    assert 2 not in got


def test_scene_bounds(spark):
    cuts = F.array(*[F.lit(x) for x in (6.0, 0.5, 3.0, 2.5)])
    assert one(spark, timeline.scene_bounds(cuts, F.lit(8.0), 2.0)) == [0.0, 2.5, 6.0, 8.0]
    assert one(spark, timeline.scene_bounds(F.array().cast("array<double>"), F.lit(1.0), 2.0)) == [0.0, 1.0]


def test_interval_edges(spark):
    s = spark.createDataFrame([("r", 1, 0.0, 5.0), ("r", 2, 5.0, 9.0)], "record string, scene int, start double, end double")
    touching = spark.createDataFrame([("r", 1, 9.0, 10.0), ("r", 2, 4.0, 5.0)], "record string, seg int, start double, end double")
    for width in (None, 2.0):
        assert [(r["scene"], r["r_seg"]) for r in timeline.overlaps(s, touching, "record", width=width).collect()] == [(1, 2)]
    p = spark.createDataFrame([("r", "a", 5.0), ("r", "b", 9.0), ("r", "c", 9.1)], "record string, p string, at double")
    assert sorted((r["scene"], r["p"]) for r in timeline.points_inside(s, p, "record").collect()) == [(1, "a"), (2, "a"), (2, "b")]
    assert sorted((r["scene"], r["p"]) for r in timeline.containing_scene(s, p, "record", "p", "start").collect()) == [(2, "a"), (2, "b")]


def test_binned_overlap_equals_plain(spark):
    rng = random.Random(3)
    make = lambda n, name: spark.createDataFrame([("r", i, float(a := rng.randint(0, 200)), float(a + rng.randint(0, 40))) for i in range(n)], f"record string, {name} int, start double, end double")
    a, b = make(60, "x"), make(60, "y")
    pairs = lambda w: sorted((r["x"], r["r_y"]) for r in timeline.overlaps(a, b, "record", width=w).collect())
    assert pairs(None) == pairs(7.0) == pairs(1000.0)


def test_interval_normaliser(spark):
    f = lambda s, e, a, b: tuple(one(spark, timeline.normalised_interval(*[F.lit(float(x)) for x in (s, e, a, b)])))
    assert f(1, 2, 10, 20) == (1.0, 2.0, "relative")
    assert f(12, 14, 10, 20) == (2.0, 4.0, "absolute_to_relative")
    assert f(3, 3, 10, 20) == (2.5, 3.5, "relative|point_to_window")
    assert f(5, 40, 10, 20) == (0.0, 10.0, "relative|invalid_to_full_scene")
    assert one(spark, timeline.frame_offsets(F.lit(2.0))) == [1.0] and one(spark, timeline.frame_offsets(F.lit(10.0))) == [1.0, 5.0, 9.0]


def test_expand_ids_rejects_unknown_and_repeated(spark):
    look = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    df = lambda ids: timeline.expand_ids(spark.createDataFrame([(1, ids)], "k int, ids string"), "k", "ids", look, "id")
    assert [(r["pos"], r["v"]) for r in df("b|a").orderBy("pos").collect()] == [(0, 2), (1, 1)]
    assert df("").collect() == []
    for bad in ("a|c", "a|a"):
        with pytest.raises(Exception, match="unknown id|repeated id"):
            df(bad).collect()


def test_window_budget(spark):
    df = spark.createDataFrame([("s", 1, 10), ("s", 2, 60), ("s", 3, 40)], "s string, t int, n int")
    kept = lambda b: [r["t"] for r in sessions.recent_window(df, "s", "t", F.col("n"), b).orderBy("t").collect()]
    assert kept(100) == [2, 3] and kept(99) == [3] and kept(39) == []
    assert [r["t"] for r in sessions.newest_that_fit(df, "s", "t", F.col("n"), 55).orderBy("t").collect()] == [1, 3]


def test_retention_and_ttl(spark):
    df = spark.createDataFrame([("s", t, 10) for t in range(1, 6)], "s string, t int, n int")
    assert [r["t"] for r in sessions.retained(df, "s", "t", "n", 3, 1000).orderBy("t").collect()] == [3, 4, 5]
    assert [r["t"] for r in sessions.retained(df, "s", "t", "n", 9, 25).orderBy("t").collect()] == [4, 5]
    s = spark.createDataFrame([("a", 90.0), ("b", 90.5)], "s string, u double")
    assert [r["s"] for r in sessions.alive(s, "u", 100.0, 10.0).collect()] == ["b"]


def test_eviction_and_streaks(spark):
    df = spark.createDataFrame([("s", 1, True, 5), ("s", 2, False, 5), ("s", 3, False, 5)], "s string, p int, user boolean, n int")
    assert sorted(r["p"] for r in sessions.evicted(df, "s", [F.col("user"), F.col("p")], F.col("n"), 10).collect()) == [1, 3]
    ev = spark.createDataFrame([("u", i, v) for i, v in enumerate(["a", "a", None, "a", "b", "b", "b"])], "u string, i int, v string")
    assert [r["streak"] for r in sessions.streaks(ev, "u", "i", F.col("v")).orderBy("i").collect()] == [1, 2, 0, 1, 1, 2, 3]


def test_sliding_chunks_cover_and_overlap():
    text = "Short one. " * 60
    spans = chunking.sliding(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text.rstrip())
    assert all(b[0] < a[1] and a[0] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert chunking.sliding("tiny text") == [(0, 9)] and chunking.sliding("  ") == []
    assert all(not text[b - 1].isalnum() or b == len(text) for _, b in spans)


def test_byte_pieces_cover_exactly():
    text = "a😀电池 end " * 20
    spans = chunking.byte_pieces(text, 16)
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(len(text[a:b].encode()) <= 16 for a, b in spans)
    assert chunking.byte_pieces("", 5) == [] and chunking.byte_pieces("😀😀", 1) == [(0, 1), (1, 2)]


def test_line_and_item_packs():
    assert chunking.line_packs("aa\nbb\n" + "c" * 7, 5) == ["aa", "bb", "ccccc", "cc"]
    assert chunking.line_packs("   ") == []
    assert chunking.item_packs(["ab", "cd", "efg"], 5) == [["ab", "cd"], ["efg"]]
    with pytest.raises(ValueError):
        chunking.item_packs(["abcdef"], 5)
    assert chunking.structured("| a |\n| b |\n- x\n- y\n<PIC>\ntext\nmore") == ["| a |\n| b |", "- x", "- y\n<PIC>", "text\nmore"]


def test_markdown_sections(spark):
    text = "# Doc\nintro\n## Safety\n- one\n\n\n\n**two**\n![a](img/p1.png?x)\n### Deep\nend <PIC:q2>\n# Other\nlast"
    rows = sections.sections(spark.createDataFrame([("m", text)], "product string, text string")).orderBy("section_id").collect()
    assert [r["heading"] for r in rows] == ["(前言)", "Safety", "Safety / Deep", "Other"]
    assert rows[1]["text"] == "• one\n\ntwo\n<PIC>" and rows[1]["pics"] == ["p1"] and rows[1]["is_special"]
    assert rows[1]["tags"] == ["has_pic", "special", "warning"]
    assert rows[2]["pics"] == ["q2"]
    check = sections.picture_check(sections.sections(spark.createDataFrame([("m", text)], "product string, text string")), spark.createDataFrame([("m", text)], "product string, text string")).first()
    assert check["aligned"]


def test_manuals_keep_whole_lines(spark, tmp_path):
    from weft.plans import texts

    long = "A single line with " + "many more words than a heading holds " * 9 + "and an end"
    spark.createDataFrame([(1, long), (2, "\n".join(f"line {i} {long}" for i in range(7))), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    body = {(r["product"], r["section_id"]): r["text"] for r in sections.sections(texts.manuals(spark, str(tmp_path))).collect()}
    part = lambda a, b: "\n".join(f"line {i} {long}" for i in range(a, b))
    assert body == {(1, 0): long, (2, 0): part(0, 5), (2, 1): part(5, 7)}
    rows = {(r["product"], r["section_id"]): (r["heading"], r["char_len"]) for r in texts.markdown_sections(spark, str(tmp_path)).collect()}
    assert rows[1, 0] == ("(前言)", len(long)) and rows[2, 1] == (f"line 5 {long}"[:40].strip(), len(part(5, 7)))
    assert {r["product"]: r["total_chars"] for r in texts.section_catalog(spark, str(tmp_path)).collect()} == {1: len(long), 2: len(part(0, 5)) + len(part(5, 7))}


def test_text_cleaning(spark):
    assert one(spark, tx.strip_markdown(F.lit("# T\n- **b** `c`\n1. *i*\n> q\\*"))) == "T\nb c\n1. i\nq*"
    assert one(spark, tx.redact_contacts(F.lit("see https://a.b/c or x@y.org call 13812345678 官网"))).split() == ["see", "or", "call"]
    assert one(spark, tx.drop_unsupported(F.lit("a\r\nb﻿😀️"))) == "a\nb"
    assert one(spark, tx.tidy(F.lit("\n a  b \n\n\n\n c \n"))) == "a b\n\nc"
    assert one(spark, tx.normalise_picture_marks(F.lit("[pic] <Pic/> x</PIC>"))) == "<PIC> <PIC> x"
    named = tx.with_inline_names(F.lit("a<PIC>b<PIC>c"), F.array(F.lit("p")))
    assert one(spark, named) == "a[[PIC:p]]b<PIC>c" and one(spark, tx.inline_names(named)) == ["p"] and one(spark, tx.without_inline_names(named)) == "a<PIC>b<PIC>c"
    assert one(spark, tx.statements(F.lit("- One is 1.5 cm. Two [VID:a] holds\n2) three"))) == ["One is 1.5 cm.", "Two  holds", "three"]
    assert one(spark, tx.answer_sentences(F.lit("Do it. [VID:s1] Then wait!"))) == ["Do it. [VID:s1]", "Then wait!"]
    assert one(spark, tx.summary(F.lit("x" * 130))) == "x" * 120 + "..."


def test_scores_and_percentiles(spark):
    groups = F.array(F.array(F.lit("red"), F.lit("blue")), F.array(F.lit("on")))
    assert one(spark, evidence.rule_score(F.lit("The Blue lamp is On"), groups, F.array(F.lit("off"))))
    assert not one(spark, evidence.rule_score(F.lit("blue, on, O f f"), groups, F.array(F.lit("off"))))
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)] + [(None,)], "v double")
    assert df.agg(evidence.nearest_rank("v", 0.95)).first()[0] == 10.0
    assert df.agg(evidence.nearest_rank("v", 0.5)).first()[0] == 5.0
    assert df.filter("v is null").agg(evidence.nearest_rank("v", 0.5)).first()[0] is None


def test_support_rule(spark):
    f = lambda a, b: one(spark, evidence.supported(F.array(*[F.lit(x) for x in a]), F.array(*[F.lit(x) for x in b])))
    assert f(["a"], ["a", "z"]) and f(["a", "b"], ["b"]) and not f(["a", "b", "c"], ["b"])
    assert f(list("abcdefgh"), ["a", "b"]) and not f(list("abcdefghi"), ["a", "b"])


def test_bootstrap_and_choice(spark):
    d = spark.createDataFrame([("x", i, 1.0) for i in range(5)], "g string, case int, difference double")
    r = evidence.paired_bootstrap(d, "g", draws=100).first()
    assert (r["n"], r["delta"], r["low"], r["gains"]) == (5, 1.0, 1.0, True)
    step = {"from": "window", "to": "tree", "gains": True, "critical_to": 0, "critical_from": 1, "same": False, "calls_to": 2, "calls_from": 1}
    assert evidence.choose_strategy([step], ["window", "rolling", "tree"]) == "tree"


def test_strict_json():
    assert evidence.strict_object('{"a": 1}', {"a"}) == (True, [])
    assert evidence.strict_object('{"a": 1, "a": 2}', {"a"})[1] == ["duplicate_key"]
    assert evidence.strict_object('{"b": 1}', {"a"})[1] == ["keys"]
    assert evidence.strict_object("no", {"a"}) == (False, ["json"])


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0]), (4, None)], "vec_id long, embedding array<double>")
    assert v.select(vectors.normalised(F.col("embedding")).alias("x")).first()["x"] == [0.6, 0.8]
    with pytest.raises(Exception, match="zero or not finite"):
        v.filter("vec_id = 2").select(vectors.normalised_strict(F.col("embedding"))).collect()
    q = v.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    assert [(r["vec_id"], r["score"]) for r in vectors.similarities(v, q, 5).orderBy("rank").collect()] == [(3, 0.96), (2, 0.0)]
    p = vectors.mean_pool(v.withColumn("o", F.lit("a")), "o").first()
    assert p["parts"] == 3 and p["pooled"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_bounded_clusters():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(23, 4))
    groups = vectors.bounded_clusters(x / np.linalg.norm(x, axis=1, keepdims=True), 5)
    assert sorted(i for g in groups for i in g) == list(range(23)) and max(map(len, groups)) <= 5
    assert sorted(i for g in vectors.bounded_clusters(np.ones((7, 3)), 3) for i in g) == list(range(7))
    assert vectors.bounded_clusters(np.zeros((0, 3)), 3) == []


def test_tree_build_and_retrieval(spark):
    same = tree.build([(i, "user", "same words here") for i in range(20)], branch=4)
    assert [x["parent"] for x in same if x["level"] == max(y["level"] for y in same)] == [None]
    forest = tree.build([(i, "user", f"word{i} extra") for i in range(20)], branch=4, levels=2)
    assert sum(x["parent"] is None for x in forest) > 1
    m = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(["pump filter", "door lock", "pump valve", "wall paint"])], "conv_id long, turn long, role string, text string")
    q = spark.createDataFrame([(1, "pump valve")], "conv_id long, question string")
    scored = tree.score_nodes(tree.session_trees(m, branch=2), q)
    best = tree.collapsed(scored, 1).first()
    assert best["text"] == "pump valve"
    assert "pump valve" in [r["text"] for r in tree.traversed(scored, 2).collect()]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id,text\n1,\"a, b\"\n2,\n", encoding="utf-8")
    rows = tables.read_manifest(spark, str(tmp_path / "m.csv"))
    assert rows.columns == ["id", "text"] and [tuple(r) for r in rows.collect()] == [("1", "a, b"), ("2", "")]
    tables.write_manifest(rows, str(tmp_path / "out"), ["text", "id"])
    assert sorted(tuple(r) for r in tables.read_manifest(spark, str(tmp_path / "out")).collect()) == [("", "2"), ("a, b", "1")]
    (tmp_path / "manuals").mkdir()
    with pytest.raises(Exception):
        tables.read_manuals(spark, str(tmp_path / "manuals")).collect()
    (tmp_path / "manuals" / "Pump 1.md").write_text("# A\nx")
    assert [tuple(r) for r in tables.read_manuals(spark, str(tmp_path / "manuals")).collect()] == [("Pump 1", "# A\nx")]
    j = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, line int, v string")
    tables.append_journal(j, str(tmp_path / "j"))
    assert tables.latest(tables.read_journal(spark, str(tmp_path / "j"), "k int, line int, v string"), "k", "line").first()["v"] == "b"
    v = spark.createDataFrame([(1, [0.0, 0.0])], "id long, vec array<double>")
    with pytest.raises(ValueError):
        tables.save_vectors(v, str(tmp_path / "v"), "id", "vec")
    p = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "doc long, term string, tf long")
    tables.save_index(p, str(tmp_path / "p"), 4)
    assert [tuple(r)[:3] for r in tables.load_postings(spark, str(tmp_path / "p"), ["b"], 4).select("doc", "term", "tf").collect()] == [(2, "b", 1)]
    found = tables.file_digests(spark, str(tmp_path / "manuals"))
    assert tables.verify_digests(found, found.withColumn("sha256", F.lit("x"))).first()["problem"] == "changed"
    with pytest.raises(ValueError):
        tables.contained(str(tmp_path), "../x")
    with pytest.raises(Exception, match="repeated"):
        tables.require_unique(j, "k").collect()


def test_allotment_is_the_surest_first():
    rng = np.random.default_rng(5)
    for _ in range(40):
        score, size = rng.normal(size=(rng.integers(1, 30), 6)).round(1), 6
        room, want = [size] * 6, {}
        for i in sorted(range(len(score)), key=lambda i: (score[i].min() - score[i].max(), i)):
            want[i] = next(c for c in sorted(range(6), key=lambda c: (-score[i, c], c)) if room[c])
            room[want[i]] -= 1
        assert vectors.allotted(score, size).tolist() == [want[i] for i in range(len(score))]


def test_tree_parents_quote_their_leaves():
    turns = [(i, "user" if i % 2 else "assistant", f"更正 型号 AB-{i} told. " + "Some filler words here. " * 60) for i in range(1, 13)]
    nodes = tree.build(turns, budget=800)
    by_id = {x["node"]: x for x in nodes}
    for x in nodes:
        assert len(x["quotes"]) <= 8 and all(q.quote in by_id[q.leaf]["text"] for q in x["quotes"])
        if x["level"]:
            assert len(x["text"].encode()) <= 700 and x["quotes"][0].worth[0]  # the user's come first
    assert all(by_id[x["parent"]]["level"] == x["level"] + 1 for x in nodes if x["parent"])


def test_tree_of_a_long_session_is_a_forest(spark):
    rows = [(1, i, "user", f"word{i} here") for i in range(tree.MESSAGES + 40)] + [(2, 0, "user", "alone"), (3, 0, None, None), (None, 0, "user", "x")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tree.session_trees(m).toPandas()
    assert set(got["conv_id"]) == {1, 2} and (got[got["conv_id"] == 1]["level"] == 0).sum() == tree.MESSAGES + 40
    assert got[(got["conv_id"] == 1) & got["parent"].isna()]["level"].max() > 0
    q = spark.createDataFrame([(1, "word7"), (2, "nothing")], "conv_id long, question string")
    assert "word7 here" in [r["text"] for r in tree.collapsed(tree.searched(m, q), 8).filter("conv_id = 1").collect()]  # others may share its place
    assert tree.collapsed(tree.searched(m, q), 5).filter("conv_id = 2").count() == 1
    assert tree.session_trees(m.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.45, "b": 0.55}, {"a": 0.3, "b": 0.35, "c": 0.35}])
def test_fused_top_k_equals_ranks_of_all_rows(spark, weights):
    rng = random.Random(5)
    rows = [(q, i, *[rng.choice([None, float("nan"), rng.randrange(300) / 7, rng.randrange(300) / 7, rng.randrange(300) / 7]) for _ in "abc"]) for q, n in ((1, 600), (2, 4), (None, 250)) for i in range(n)]
    got = ranking.fused_top_k(spark.createDataFrame(rows, "q long, doc long, a double, b double, c double"), ["q"], "doc", weights, 10).collect()
    want = set()
    for q in (1, 2, None):
        mine, total = [r for r in rows if r[0] == q], {}
        for at, name in enumerate("abc", 2):
            low = lambda r, at=at: float("-inf") if r[at] is None or math.isnan(r[at]) else r[at]
            for rank, r in enumerate(sorted(mine, key=lambda r: (-low(r), r[1])), 1):
                total[r[1]] = total.get(r[1], 0.0) + weights.get(name, 0.0) / (60 + rank)
        best = sorted(((-round(s, 9), d) for d, s in total.items()))[:10]
        want |= {(q, d, -s, n) for n, (s, d) in enumerate(best, 1)}
    assert {(r["q"], r["doc"], r["score"], r["rank"]) for r in got} == want
    assert ranking.fused_top_k(spark.createDataFrame([], "q long, doc long, a double, b double, c double"), ["q"], "doc", weights, 10).count() == 0


def test_rejected_instruction_empties_its_answer(spark):
    rows = [(1, 0, None, True), (1, 1, "x", True), (1, 2, "y", False), (2, 0, "x", False), (2, 1, None, True), (2, 2, "x", None), (None, 0, "x", True), (None, 1, None, None)]
    got = evidence.scoped_claims(spark.createDataFrame(rows, "a long, n long, reason string, does boolean"), "a", "reason", "does").collect()
    again = evidence.REVALIDATE
    assert {(r["a"], r["n"]): r["reason"] for r in got} == {(1, 0): again, (1, 1): "x", (1, 2): "y", (2, 0): "x", (2, 1): None, (2, 2): "x", (None, 0): "x", (None, 1): again}


def test_scene_tags_that_back_nothing_go(spark):
    answers = spark.createDataFrame([(1, "Press the green reset lever. [VID:s1] [VID:s2]\nTurn left [VID:s9] now. Green lever [VID:s1] glows!"), (2, "Green reset lever. [VID:s1]"), (3, None)], "k long, answer string")
    scenes = spark.createDataFrame([(1, "s1", "the reset lever, green"), (1, "s2", "something else entirely"), (1, "s2", None)], "k long, scene string, text string")
    got = {(r["k"], r["pos"]): (r["sentence"], r["cited"]) for r in evidence.cited_scenes(answers, scenes, "k", "answer", "scene", "text").collect()}
    assert got == {
        (1, 0): ("Press the green reset lever. [VID:s1]", ["s1"]),
        (1, 1): ("Turn left  now.", []),
        (1, 2): ("Green lever [VID:s1] glows!", ["s1"]),
        (2, 0): ("Green reset lever.", []),
    }


def test_links_outside_the_allowed_hosts(spark):
    rows = [("see https://Docs.example.org/a?b and http://u@evil.example:80/x, http://evil.example",), ("no link",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.foreign_links(F.col("t"), ["docs.example.org"])).collect()]
    assert got == [["evil.example"], [], []]
