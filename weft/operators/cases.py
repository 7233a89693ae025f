"""A synthetic evaluation set, its checks, and the rule scorer for whole answers."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys of a citation, the least part of a gold quote that counts, and what denies the value behind it (but for `not`, which the English cases need).
CITATION, LEAST_QUOTE, DENIAL = {"turn_id", "role", "quote"}, 8, "不是|并非|非|not"
CATEGORIES = ("goal", "identifier", "constraint", "correction", "symptom", "action", "unknown")
TURNS = {"development": (40, 80), "test": (40, 40, 80, 80, 80, 160, 160, 160)}
SCHEMA = """id string, category string, split string, family string, question string,
  records array<struct<id: int, question: string, answer: string>>, answerable boolean, expected string,
  sources array<struct<turn_id: int, role: string, quote: string>>, required array<array<string>>, forbidden array<string>"""


def make_case(category: str, split: str, n: int, turns: int, seed: int) -> tuple:
    rng = random.Random(f"{seed}/{category}/{split}/{n}")
    name, old = f"X{rng.randrange(100, 999)}-{category[:3].upper()}{n}", f"Y{rng.randrange(100, 999)}"
    at = rng.randrange(2, turns - 2)
    said = {"correction": f"Correction: the model is {name}, not {old}.", "unknown": "Nothing to note here."}.get(category, f"Please note the {category} is {name}.")
    records = [(i, said if i == at else f"Routine question {rng.randrange(10**6)}?", f"Routine answer {rng.randrange(10**6)}.") for i in range(1, turns + 1)]
    known = category != "unknown"
    return (
        f"{category}-{split}-{n}", category, split, f"{split}-{category}-{n % 3}", f"What is the {category} noted earlier?", records, known, name if known else "", [(at, "user", said)] if known else [],
        [[name]] if known else [["not known", "unknown"]], [old] if category == "correction" else [],
    )


def dataset(spark: SparkSession, seed: int = 7) -> DataFrame:
    """Two development and eight test cases of each category."""
    rows = [make_case(c, split, n, turns, seed) for c in CATEGORIES for split, sizes in TURNS.items() for n, turns in enumerate(sizes)]
    return spark.createDataFrame(rows, SCHEMA)


def problems(cases: DataFrame) -> DataFrame:
    """id and problem: repeated ids, families in both splits, gold quotes that their turn doesn't hold."""
    twice = cases.groupBy("id").count().filter("count > 1").selectExpr("id", "'repeated id' AS problem")
    leak = cases.groupBy("family").agg(F.count_distinct("split").alias("n")).filter("n > 1").selectExpr("family AS id", "'family in both splits' AS problem")
    absent = cases.filter("exists(sources, s -> NOT exists(records, r -> r.id = s.turn_id AND contains(r.question, s.quote)))").selectExpr("id", "'quote absent' AS problem")
    return twice.union(leak).union(absent)


def squeezed(text: str) -> str:
    return re.sub(r"\s+", "", text).lower()


class Gold:
    """What a case asks of an answer, made ready once."""

    def __init__(self, case: dict):
        self.groups = [[squeezed(t) for t in g] for g in case["required"]]
        self.forbidden = [squeezed(t) for t in case["forbidden"]]
        # naming an old value in order to deny it is no fault where a correction is asked for
        deniable = self.forbidden if case["category"] == "correction" else []
        self.denials = [re.compile(f"(?:{DENIAL}){re.escape(t)}") for t in deniable]
        self.answerable = case["answerable"]
        self.said = {r["id"]: r["question"] for r in case["records"]}
        self.quotes: dict[int, list[str]] = {}
        for s in case["sources"]:
            self.quotes.setdefault(s["turn_id"], []).append(s["quote"])

    def stated(self, answer: str) -> bool:
        """Whether a term of each group is there, and no forbidden one but in a denial."""
        held = squeezed(answer)
        rest = held
        for d in self.denials:
            rest = d.sub("", rest)
        return not any(t in rest for t in self.forbidden) and all(map(lambda g: any(t in held for t in g), self.groups))

    def sound(self, cited, visible: str) -> bool:
        """Whether a citation quotes the user's words of a known turn, and ones that were visible."""
        if type(cited) is not dict or cited.keys() != CITATION:
            return False
        turn, quote = cited["turn_id"], cited["quote"]
        if cited["role"] != "user" or type(turn) is not int or type(quote) is not str or not quote.strip():
            return False
        return quote in self.said.get(turn, "") and quote in visible

    def meets(self, cited: dict) -> bool:
        """Whether a sound citation holds a gold quote, or eight characters or more of one."""
        return any(q in cited["quote"] or len(cited["quote"]) >= LEAST_QUOTE and cited["quote"] in q for q in self.quotes.get(cited["turn_id"], ()))


def score(value, case: dict, visible: str) -> dict:
    """fact, citation, passed of an answer {answer, sources}. Every citation must be sound, and one of them meet the gold; an unanswerable case wants none."""
    fact = citation = False
    if type(value) is dict and value.keys() == {"answer", "sources"} and type(value["sources"]) is list and type(value["answer"]) is str and value["answer"].strip():
        gold, cited = Gold(case), value["sources"]
        good = [c for c in cited if gold.sound(c, visible)]
        fact = gold.stated(value["answer"])
        citation = len(good) == len(cited) and (any(map(gold.meets, good)) if gold.answerable else not cited)
    return {"fact": fact, "citation": citation, "passed": fact and citation}


def scores(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """id, fact, citation, passed. answers: id, value (JSON text; anything else fails), visible (null: nothing)."""

    def parsed(text):
        try:
            return json.loads(text)
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            got = [score(parsed(r["value"]), r, r["visible"] or "") for r in rows]
            yield pa.RecordBatch.from_pydict({"id": pa.array([r["id"] for r in rows], pa.string()), **{k: pa.array([g[k] for g in got], pa.bool_()) for k in ("fact", "citation", "passed")}})

    rows = answers.select("id", "value", "visible").join(cases, "id")
    return rows.mapInArrow(run, "id string, fact boolean, citation boolean, passed boolean")
