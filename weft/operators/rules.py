"""A relational rule engine over texts: finite phrase rules, anchored in sources, as rows.

A rule is rows of (rule, part, grp, phrase). Its parts are `question`, `source`, `claim` and `never`;
within a part every group must be met, by any of its phrases. Texts and phrases are compared as
words: lower case, everything but letters and digits is one blank, and a phrase counts where it
stands as whole words.

All phrases are looked for in one pass over a text by an automaton, which makes rows of (text,
phrase); from there on rules are joins and counts. Phrases go to the tasks in parts of at most
PART_BYTES, each part one pass; the rules themselves are joined as a dimension of checked size.

An omission is a rule that applies to an answer (its question part holds, and one source of the answer
meets the source part) while no claim keeps it: a claim that cites such a source, with a sentence that meets
the claim part and none of the `never` phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as tx
from weft.operators.routing import MAX_DIMENSION_BYTES

#: Bytes of phrases in one automaton.
PART_BYTES = 16 << 20
PARTS = ("question", "source", "claim", "never")


def plain(text: Column) -> Column:
    """A text as words between blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def parted(phrases: DataFrame, part_bytes: int) -> Iterator[list[str]]:
    """Distinct phrases in parts of bounded bytes; the driver holds one part at a time."""
    held, size = [], 0
    for (phrase,) in phrases.toLocalIterator():
        if held and size + len(phrase.encode()) > part_bytes:
            yield held
            held, size = [], 0
        held.append(phrase)
        size += len(phrase.encode())
    if held:
        yield held


def found(texts: DataFrame, text: str, phrases: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns of texts but the text, and phrase: a row for each distinct phrase that stands in a text. phrases: phrase, as plain() makes them."""
    rows = texts.withColumn(text, plain(F.col(text)))
    keys = [c for c in texts.columns if c != text]
    rows = rows.select(*keys, text)
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("phrase", T.StringType())])
    out = None
    for part in parted(phrases.select("phrase").filter("trim(phrase) <> ''").distinct(), part_bytes):
        sent = rows.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for p in sent.value:
                machine.add_word(p, p)
            machine.make_automaton()
            for batch in batches:
                at, hits = [], []
                for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    met = dict.fromkeys(p for _, p in machine.iter(t))
                    at += [i] * len(met)
                    hits += met
                kept = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(hits, pa.string())], schema=pa.schema([*list(kept.schema)[:-1], pa.field("phrase", pa.string())]))

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.select(*keys, F.lit(None).cast("string").alias("phrase")).filter("false")


class Rules:
    """Rule rows with their phrases as plain() makes them; an unknown part, an empty phrase or a null raises ValueError.

    One look at the table tells whether it is valid and whether its bytes let it be sent to every task.
    """

    def __init__(self, rules: DataFrame):
        rows = rules.select("rule", "part", "grp", plain(F.col("phrase")).alias("phrase"))
        ok = F.col("rule").isNotNull() & F.col("part").isin(*PARTS) & F.col("grp").isNotNull() & (F.trim("phrase") != "")
        size = F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length(F.col("rule").cast("string")), F.lit(0)) + 40)
        bad, total = rows.agg(F.count_if(~F.coalesce(ok, F.lit(False))), size).first()
        if bad:
            raise ValueError(f"{bad} rule rows are not valid")
        self.rows, self.small = rows, (total or 0) <= MAX_DIMENSION_BYTES

    def part(self, *parts: str) -> DataFrame:
        return self.rows.filter(F.col("part").isin(*parts))

    def sent(self, df: DataFrame) -> DataFrame:
        """A table of at most a row for each of these, broadcast if all of them may be."""
        return F.broadcast(df) if self.small else df


def met(hits: DataFrame, rules: Rules, part: str, by: list[str]) -> DataFrame:
    """by and rule: where every group of a rule's part is met. hits: by, phrase."""
    mine = rules.part(part)
    need = mine.groupBy("rule").agg(F.count_distinct("grp").alias("need"))
    have = hits.join(rules.sent(mine.select("rule", "grp", "phrase")), "phrase").groupBy(*by, "rule").agg(F.count_distinct("grp").alias("have"))
    return have.join(rules.sent(need), "rule").filter("have = need").select(*by, "rule")


def by_sentence(texts: DataFrame, text: str) -> DataFrame:
    """A row for each sentence of a text, with its place in pos."""
    keys = [c for c in texts.columns if c != text]
    return texts.select(*keys, F.posexplode(tx.sentences(F.col(text))).alias("pos", text))


def omissions(answers: DataFrame, sources: DataFrame, claims: DataFrame, rules: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """answer, rule, source (the least that anchors it), sources: rules that apply to an answer and that none of its claims keeps.

    answers: answer, question; sources: answer, source, text; claims: answer, claim, text, cited (an array of sources; null:
    all of the answer's). Null and empty texts meet nothing; rows with a null answer, source or claim take no part.
    """
    rules = Rules(rules)
    s = sources.filter("answer IS NOT NULL AND source IS NOT NULL").select("answer", "source", "text")
    anchored = met(found(s, "text", rules.part("source"), part_bytes), rules, "source", ["answer", "source"])
    asked = met(found(answers.filter("answer IS NOT NULL").select("answer", "question"), "question", rules.part("question"), part_bytes), rules, "question", ["answer"])
    gated = rules.part("question").select("rule").distinct().withColumn("gated", F.lit(True))
    applies = anchored.join(rules.sent(gated), "rule", "left").join(asked.withColumn("asked", F.lit(True)), ["answer", "rule"], "left")
    applies = applies.filter("gated IS NULL OR asked").select("answer", "rule", "source")
    c = by_sentence(claims.filter("answer IS NOT NULL AND claim IS NOT NULL").select("answer", "claim", "cited", "text"), "text")
    hits = found(c, "text", rules.part("claim", "never"), part_bytes)
    said = met(hits, rules, "claim", ["answer", "claim", "pos", "cited"])
    broken = hits.join(rules.sent(rules.part("never").select("rule", "phrase")), "phrase").select("answer", "claim", "pos", "rule")
    said = said.join(broken, ["answer", "claim", "pos", "rule"], "left_anti")
    kept = applies.join(said, ["answer", "rule"]).filter("cited IS NULL OR array_contains(cited, source)").select("answer", "rule")
    left = applies.groupBy("answer", "rule").agg(F.min("source").alias("source"), F.count_distinct("source").alias("sources"))
    return left.join(kept, ["answer", "rule"], "left_anti").select("answer", "rule", "source", "sources")


def first_rules(texts: DataFrame, key: str, text: str, rules: DataFrame, order: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """key and rule: the first rule, by `order` (rule, rule_order), whose claim part a text meets within a sentence that holds none of its `never` phrases."""
    rules = Rules(rules)
    hits = found(by_sentence(texts.filter(F.col(key).isNotNull()).select(key, text), text), text, rules.part("claim", "never"), part_bytes)
    broken = hits.join(rules.sent(rules.part("never").select("rule", "phrase")), "phrase").select(key, "pos", "rule")
    rows = met(hits, rules, "claim", [key, "pos"]).join(broken, [key, "pos", "rule"], "left_anti").join(rules.sent(order.select("rule", "rule_order")), "rule")
    return rows.groupBy(key).agg(F.min(F.struct("rule_order", "rule")).alias("x")).select(key, "x.rule")
