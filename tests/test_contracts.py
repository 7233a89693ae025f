import json

import pytest
from pyspark.sql import functions as F

from weft.functions import excerpts
from weft.operators import cases, contracts, evidence, requests, revisions


def test_excerpt_keeps_ends_and_marks_the_gap():
    text = "First part. " * 20 + "Middle. " * 20 + "Last words here."
    out = excerpts.excerpt(text, 120)
    assert out.startswith("First part.") and out.endswith("Last words here.") and excerpts.OMITTED in out
    assert excerpts.excerpt("short", 10) == "short"


def test_observe_prefers_important_sentences():
    text = "Plain words here. " * 30 + "The model AB-12 failed. " + "More plain words. " * 30
    out = excerpts.observe(text, 160)
    assert "The model AB-12 failed." in out and len(out) <= 160


def test_fit_counts_bytes():
    assert excerpts.size(excerpts.fit("电池" * 500, 300)) <= 300
    assert excerpts.fit("x" * 500, 60) in (excerpts.fit("x" * 500, 60), excerpts.OFFLOADED) and excerpts.fit("x" * 500, 20) == excerpts.SHORT_OFFLOADED
    assert excerpts.repair_bare_marks("PIC a PIC <PIC> EPIC", 2) == "<PIC> a PIC <PIC> EPIC"
    assert excerpts.without_names("see p1 and p12", ["p1", "p12"]) == "see  and "


SOURCES = {"M1": "Press the red button twice.", "M2": "Then wait."}


def claim(**change):
    return {"text": "Press it twice", "verdict": "supported", "evidence": [{"source_id": "M1", "quote": "red button twice"}]} | change


RATED = {"requested_task": "t", "answerability": "complete", "reason": "r"}
REPLIES = [
    ({"claims": [claim()], "insufficient": False}, None),
    ({"claims": [], "insufficient": True}, None),
    ({"claims": [], "insufficient": False}, "number of claims"),
    ({"claims": [claim()] * 7, "insufficient": False}, "number of claims"),
    ({"claims": [claim()], "insufficient": 0}, "types"),
    ({"claims": {}, "insufficient": True}, "types"),
    ({"claims": [claim(verdict="partial")], "insufficient": False}, "verdict"),
    ({"claims": [claim(evidence=[{"source_id": "M1", "quote": "blue"}])], "insufficient": False}, "reference"),
    ({"claims": [claim(evidence=[{"source_id": "M9", "quote": "red"}])], "insufficient": False}, "reference"),
    ({"claims": [claim(evidence=[{"source_id": "M1", "quote": "red"}] * 2)], "insufficient": False}, "reference"),
    ({"claims": [claim(evidence=[{"source_id": "M1", "quote": "red"}, {"source_id": "M2", "quote": "wait"}])], "insufficient": False}, None),
    ({"claims": [claim(evidence=[])], "insufficient": False}, "evidence"),
    ({"claims": [claim(evidence=[{"source_id": "M1"}])], "insufficient": False}, "keys"),
    ({"claims": [claim(evidence=[{"source_id": 1, "quote": "red"}])], "insufficient": False}, "text"),
    ({"claims": [claim(text="a\n\nb")], "insufficient": False}, "markup"),
    ({"claims": [claim(text=" \n")], "insufficient": False}, "text"),
    ({"claims": [claim(text="x" * 1201)], "insufficient": False}, "text"),
    ({"claims": [claim(x=1)], "insufficient": False}, "keys"),
    ({"claims": [claim(), claim(verdict="no"), claim(text="")], "insufficient": False}, "verdict"),
    ({"claims": [claim()], "insufficient": False, "x": 1}, "keys"),
    ([1], "keys"),
    ({"claims": [claim()], "insufficient": True, "assessment": RATED}, "insufficiency"),
    ({"claims": [claim()], "insufficient": False, "assessment": RATED}, None),
    ({"claims": [claim()], "insufficient": False, "assessment": RATED | {"x": 1}}, "keys"),
    ({"claims": [claim()], "insufficient": True, "assessment": RATED | {"answerability": "none"}}, "claims without an answer"),
    ({"claims": [claim()], "insufficient": False, "assessment": RATED | {"answerability": "all"}}, "answerability"),
    ({"claims": [claim()], "insufficient": False, "assessment": RATED | {"missing_parts": ["a"], "required_conditions": []}}, "missing parts of a complete answer"),
    ({"claims": [claim()], "insufficient": False, "assessment": RATED | {"missing_parts": [], "required_conditions": ["b", "b"]}}, "required_conditions"),
    ({"claims": [claim()], "insufficient": False, "assessment": RATED | {"missing_parts": []}}, "keys"),
    ('{"claims": [], "claims": [], "insufficient": true}', "duplicate key"),
    ('{"claims": [{"text": "a", "text": "b"}], "insufficient": true}', "duplicate key"),
    ("{", "json"),
    ("", "json"),
    (None, "size"),
    ('{"claims": [], "insufficient": true}' + " " * 32_000, "size"),
]


def test_revisions(spark):
    rows = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, (v, _) in enumerate(REPLIES)]
    sources = spark.createDataFrame([(i, s, t) for i, _ in rows for s, t in SOURCES.items()], "key long, source string, text string")
    df = spark.createDataFrame(rows, "id long, raw string")
    got = {r["id"]: (r["ok"], r["problem"]) for r in revisions.checked(df, sources, "id", "raw").collect()}
    for i, (value, problem) in enumerate(REPLIES):
        assert got[i] == (problem is None, problem), value
    first = revisions.claims(df.filter("id = 0"), "id", "raw").first()
    assert first["text"] == "Press it twice" and [tuple(e) for e in first["evidence"]] == [("M1", "red button twice")]


def test_revisions_of_odd_tables(spark):
    sources = spark.createDataFrame([], "key long, source string, text string")
    df = spark.createDataFrame([(None, "{"), (None, json.dumps({"claims": [], "insufficient": True})), (2, json.dumps({"claims": [], "insufficient": True}))], "id long, raw string")
    assert sorted(map(tuple, revisions.checked(df, sources, "id", "raw").collect()), key=repr) == [(2, True, None), (None, False, "json")]
    assert revisions.checked(df.limit(0), sources, "id", "raw").count() == 0


def test_audit_derives_answerability():
    catalog = {"E1": {"source_id": "M1", "quote": "a"}, "E2": {"source_id": "M1", "quote": "b"}}
    value = {"tasks": {"T1": "how", "T2": "why"}, "checks": {"S1": {"reason": "r", "verdict": "supported", "passage_ids": ["E1"]}, "S2": {"reason": "r", "verdict": "irrelevant", "passage_ids": []}}, "coverage": {"T1": ["S1"], "T2": []}}
    got = contracts.audit(json.dumps(value), {"S1": "one", "S2": "two"}, catalog, "how and why")
    assert got["answerability"] == "partial" and got["missing"] == ["T2"] and [c["text"] for c in got["claims"]] == ["one"]
    value["checks"]["S1"]["passage_ids"] = ["E1", "E2"]
    with pytest.raises(contracts.Broken, match="one passage a source"):
        contracts.audit(json.dumps(value), {"S1": "one", "S2": "two"}, catalog)


def test_summary_contract(spark):
    turns = spark.createDataFrame([(k, 1, "the pump leaks", "check the seal") for k in range(20)], "id long, turn_id long, question string, answer string")
    cited = lambda **c: {"text": "leak", "sources": [{"turn_id": 1, "role": "user", "quote": "pump leaks"} | c]}
    whole = lambda **fields: {f: [] for f in revisions.SUMMARY_FIELDS} | fields
    cases_ = [
        (whole(confirmed_symptoms=[cited()]), None),
        (whole(confirmed_symptoms=[cited(role="assistant")]), "role or turn"),
        (whole(confirmed_symptoms=[cited(turn_id=2)]), "role or turn"),
        (whole(confirmed_symptoms=[cited(turn_id=True)]), "role or turn"),
        (whole(confirmed_symptoms=[cited(quote="check the seal")]), "quote"),
        (whole(unverified_assistant_advice=[cited(role="assistant", quote="the seal")]), None),
        (whole(unverified_assistant_advice=[cited()]), "role or turn"),
        (whole(), "empty"),
        ({"equipment": []}, "keys"),
        (whole(equipment=3), "list"),
        (whole(equipment=[cited()] * 21), "list"),
        (whole(equipment=[{"text": "x", "sources": []}]), "sources"),
        (whole(equipment=[{"text": "", "sources": cited()["sources"]}]), "text"),
        (whole(equipment=[cited(x=1)]), "keys"),
        (whole(equipment=[cited() | {"text": "x" * 600}]), "budget"),
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(cases_)], "id long, raw string")
    got = {r["id"]: r for r in revisions.summaries(df, turns, "id", "raw", 500).collect()}
    assert [(got[i]["ok"], got[i]["problem"]) for i in range(len(cases_))] == [(p is None, p) for _, p in cases_]
    assert got[0]["text"] == "confirmed_symptoms: leak [turn=1; user] pump leaks"
    long = whole(current_goal=[cited(), cited() | {"text": "x" * 450}, cited() | {"text": "second"}])
    out = revisions.summaries(spark.createDataFrame([(0, json.dumps(long))], "id long, raw string"), turns, "id", "raw", 500).first()["text"]
    assert [x.split(" [")[0] for x in out.split("\n")] == ["current_goal: leak", "current_goal: second"]


def test_rule_summary():
    out = contracts.rule_summary([{"id": i, "question": f"q{i} " * 30, "answer": "a"} for i in range(5)], 400)
    assert out[0].startswith("[turn=4; user]") and sum(map(excerpts.size, out)) + len(out) - 1 <= 400


def test_rerank_parsing():
    assert contracts.rerank({"data": [{"index": "1", "score": "0.5"}, {"score": None}, {"index": 9, "score": 1}, "x"]}, 3) == [(1, 0.5), (1, 0.0)]
    assert contracts.rerank({"results": [{"index": 0, "relevance_score": 1}, {"index": 1, "relevance_score": 2.5}]}, 2, strict=True) == [(1, 2.5), (0, 1.0)]
    for bad in ({"results": [{"index": True, "relevance_score": 1}]}, {"results": []}, {"results": [{"index": 0, "relevance_score": 1}] * 2}):
        with pytest.raises(contracts.Broken):
            contracts.rerank(bad, 2, strict=True)
    with pytest.raises(contracts.Broken):
        contracts.rerank({"results": []}, 2)


def test_numbered_blocks():
    text = "intro\n1. a\nx\n2) b\n"
    assert [text[a:b] for a, b in contracts.numbered_blocks(text)] == ["1. a\nx\n", "2) b\n"] or [text[a:b].strip() for a, b in contracts.numbered_blocks(text)] == ["1. a\nx", "2) b"]
    assert contracts.numbered_blocks("1. only") == []


MESSAGE = "request long, pos long, role string, text string, calls array<string>, answers string, pictures int"
TALK = [(0, "system", "s", [], None), (1, "user", "first", [], None), (2, "assistant", "", ["a"], None), (3, "tool", "x" * 900, [], "a"), (4, "assistant", "", ["b"], None), (5, "tool", "y" * 900, [], "b"), (6, "user", "now", [], None)]


def budgets(spark, talk, windows, protected=None, fragments=None):
    """Plans and reports of one request under several windows, by window."""
    m = spark.createDataFrame([(i, p, r, t, c, a, pics[0] if pics else 0) for i in range(len(windows)) for p, r, t, c, a, *pics in talk], MESSAGE)
    q = spark.createDataFrame([(i, w, 0, protected) for i, w in enumerate(windows)], "request long, window long, reserve long, protected array<string>")
    f = None if fragments is None else spark.createDataFrame([(i, n, x) for i in range(len(windows)) for n, x in fragments], "request long, number int, fragment string")
    plan, report = requests.planned(m, q, f)
    plan = plan.cache()
    done = {r["request"]: r for r in report.collect()}
    actions = {i: {r["pos"]: r["action"] for r in plan.filter(F.col("request") == i).collect()} for i in range(len(windows))}
    texts = {}
    for r in requests.carried_out(m, plan, spark.createDataFrame([], "request long, question string")).orderBy("pos").collect():
        texts.setdefault(r["request"], {})[r["pos"]] = r["text"]
    return done, actions, texts


def test_request_budget_order_and_inclusive_bound(spark):
    whole = budgets(spark, TALK, [10**6])[0][0]["before"]
    done, actions, texts = budgets(spark, TALK, [whole, whole - 1, 700, 50])
    assert done[0]["fits"] and set(actions[0].values()) == {"kept"} and done[0]["after"] == whole
    assert done[1]["exchanges"] == 1 and done[1]["fits"] and sorted(p for p, x in actions[1].items() if x == "exchange") == [2, 3] and done[1]["results"] == 0
    assert done[2]["results"] == 1 and actions[2][5] == "cut" and len(texts[2][5].encode()) <= 900 and texts[2][0] == "s" and texts[2][6] == "now"
    assert not done[3]["fits"] and {p for p, x in actions[3].items() if x in ("kept", "cut")} == {0, 1, 4, 5, 6}


def test_exchanges_are_whole_and_never_the_last(spark):
    open_ = [TALK[0], TALK[1], (2, "assistant", "", ["a", "c"], None), *TALK[3:]]  # one call isn't answered
    late = [*TALK[:3], (3, "assistant", "well", [], None), (4, "tool", "x" * 900, [], "a"), (5, "assistant", "", ["b"], None), (6, "user", "now", [], None)]  # answered after the next reply
    for talk in (open_, late):
        done, actions, _ = budgets(spark, talk, [600])
        assert done[0]["exchanges"] == 0 and done[0]["results"] >= 1
    guarded = [*TALK[:2], (2, "assistant", "look at this", ["a"], None), *TALK[3:]]
    assert budgets(spark, guarded, [600], protected=["look at this"])[0][0]["exchanges"] == 0


def test_fragments_pictures_and_protected_texts(spark):
    old = "old fragment " * 20
    talk = [(0, "system", f"s {old}", [], None), (1, "user", f"a {old} b", [], None), (2, "user", "now", [], None)]
    whole = budgets(spark, talk, [10**6])[0][0]["before"]
    done, actions, texts = budgets(spark, talk, [whole - 1], protected=["now"], fragments=[(1, "now"), (2, old), (0, "absent")])
    assert done[0]["optional"] == 1 and done[0]["messages"] == 0 and texts[0] == {0: f"s {old}", 1: f"a {contracts.OLD_LEFT_OUT} b", 2: "now"}
    done, actions, _ = budgets(spark, [(0, "user", "", [], None, 1), (1, "user", "q", [], None)], [10])
    assert not done[0]["fits"] and actions[0] == {0: "kept", 1: "kept"} and done[0]["before"] > requests.PICTURE
    plain = [(0, "user", "first", [], None), *[(i, "assistant", "z" * 100, [], None) for i in range(1, 6)], (6, "user", "last", [], None)]
    whole = budgets(spark, plain, [10**6])[0][0]["before"]
    _, actions, _ = budgets(spark, plain, [whole - 150])
    assert sorted(p for p, x in actions[0].items() if x == "message") == [4, 5]


def test_cases_and_scores(spark):
    c = cases.dataset(spark)
    assert c.count() == 70 and cases.problems(c).count() == 0
    assert cases.problems(c.withColumn("family", F.lit("one"))).count() == 1
    row = c.filter("category = 'correction'").first().asDict(recursive=True)
    seen = "\n".join(r["question"] for r in row["records"])
    right = {"answer": f"It is {row['expected']}, not {row['forbidden'][0]}", "sources": row["sources"]}
    assert cases.score(right, row, seen)["passed"]
    assert not cases.score(right | {"answer": f"{row['expected']} {row['forbidden'][0]}"}, row, seen)["fact"]
    assert not cases.score(right | {"sources": []}, row, seen)["citation"]
    assert not cases.score(right, row, "")["citation"] and not cases.score("x", row, seen)["passed"]


def test_picture_lines_and_claim_spans(spark):
    pics = spark.createDataFrame([(1, "p", 0, "a"), (1, "p", 1, "b"), (1, "p", 2, "a"), (1, "p", 3, "c")], "k int, product string, pos int, pic string")
    caps = spark.createDataFrame([("p", "a", "part_view", None, "Knob", "x" * 300), ("p", "b", "noise", None, "n", "n"), ("p", "c", "info_table", "mismatch", "", "table")], "product string, pic string, category string, section_fit string, short_caption string, content string")
    assert evidence.picture_lines(pics, caps, "k").first()["lines"] == "- [[PIC:a]] Knob: " + "x" * 260 + "...\n- [[PIC:c]] table"
    a = spark.createDataFrame([(1, "One two. Three four. Five.")], "k int, answer string")
    c = spark.createDataFrame([(1, 7, "One two. Three four.")], "k int, claim_no int, claim string")
    assert [r["claim_no"] for r in evidence.spans_of_claims(a, c, "k", "answer", "claim").orderBy("pos").collect()] == [7, 7, None]
