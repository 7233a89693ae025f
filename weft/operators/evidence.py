"""Provenance and evaluation: citations, contracts, scores and paired statistics."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as tx
from weft.operators.batches import bounded
from weft.operators.routing import dimension


def supported(sentence_tokens: Column, evidence_tokens: Column) -> Column:
    """Whether evidence backs a sentence: two shared tokens (one if it has at most two) and a quarter of its tokens."""
    shared, n = F.size(F.array_intersect(sentence_tokens, evidence_tokens)), F.size(sentence_tokens)
    return (n > 0) & (shared >= F.when(n <= 2, 1).otherwise(2)) & (shared >= 0.25 * n)


def citations(answers: DataFrame, evidence: DataFrame, key: str, answer: str, evidence_id: str, text: str) -> DataFrame:
    """key, pos, sentence and the ids of the evidence (of the same key) that supports it."""
    s = answers.select(key, F.posexplode(tx.answer_sentences(F.col(answer))).alias("pos", "sentence")).withColumn("st", tx.citation_tokens(F.col("sentence")))
    e = evidence.select(key, F.col(evidence_id).alias("eid"), tx.citation_tokens(F.col(text)).alias("et"))
    hit = s.join(e, key, "left").withColumn("eid", F.when(supported(F.col("st"), F.col("et")), F.col("eid")))
    return hit.groupBy(key, "pos", "sentence").agg(F.array_sort(F.collect_set("eid")).alias("supports"))


def quotes_hold(quotes: DataFrame, turns: DataFrame, on: list[str], quote: str, text: str, role: str) -> DataFrame:
    """quotes plus ok: the quoted text stands in a turn with its keys and role."""
    t = turns.select(*on, F.col(role).alias("__role"), F.col(text).alias("__text"))
    hit = (F.col(role) == F.col("__role")) & F.col("__text").contains(F.col(quote)) & (F.trim(quote) != "")
    rows = quotes.withColumn("__q", F.monotonically_increasing_id()).join(t, on, "left")
    return rows.groupBy("__q", *quotes.columns).agg(F.max(F.coalesce(hit, F.lit(False))).alias("ok")).drop("__q")


def passage_cuts(text: str, most: int = 2800) -> list[str]:
    """A text as trimmed passages of at most `most` characters, parted at the last empty line, else line end or blank, else anywhere."""
    out, rest = [], text.strip()
    while len(rest) > most:
        window = rest[:most]
        at = window.rfind("\n\n")
        if at <= 0:
            at = max(window.rfind(x) for x in "\n ")
        at = at if at > 0 else most
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [p for p in (*out, rest) if p]


def passages(sources: DataFrame, by: str, source_id: str, text: str, most: int = 2800) -> DataFrame:
    """by, source_id, passage, quote: passages numbered E1, E2, ... over all sources of a group, in the sources' order.

    Texts are cut where they lie, in batches of bounded bytes; numbers come from the sources' counts, so that the texts are never sorted.
    """
    bounded(sources.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: passage_cuts(x or "", most))

    rows = sources.select(by, source_id, cut(F.col(text)).alias("cut"))
    before = F.sum(F.size("cut")).over(W.partitionBy(by).orderBy(source_id)) - F.size("cut")
    start = rows.select(by, source_id, before.alias("before"))
    pieces = rows.select(by, source_id, F.posexplode("cut").alias("pos", "quote")).join(start, [by, source_id])
    return pieces.select(by, source_id, F.concat(F.lit("E"), (F.col("before") + F.col("pos") + 1).cast("string")).alias("passage"), "quote")


def claims_hold(claims: DataFrame, catalog: DataFrame, by: str) -> DataFrame:
    """by, claim_id, known (all passages exist, none twice), one_each (no source twice). claims: by, claim_id, passage_ids; catalog: by, passage, source_id."""
    rows = claims.select(by, "claim_id", F.posexplode_outer("passage_ids").alias("pos", "passage")).join(catalog.select(by, "passage", "source_id"), [by, "passage"], "left")
    n, known = F.count("passage"), F.count("source_id")
    return rows.groupBy(by, "claim_id").agg(((n > 0) & (n == known) & (n == F.count_distinct("passage"))).alias("known"), (known == F.count_distinct("source_id")).alias("one_each"))


def bound_claims(claims: DataFrame, catalog: DataFrame, by: str) -> DataFrame:
    """by, claim_id, evidence: the passages of each claim that holds, in its order."""
    good = claims_hold(claims, catalog, by).filter("known AND one_each").select(by, "claim_id")
    rows = claims.join(good, [by, "claim_id"], "left_semi").select(by, "claim_id", F.posexplode("passage_ids").alias("pos", "passage"))
    rows = rows.join(catalog.select(by, "passage", "source_id", "quote"), [by, "passage"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_id", "quote"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["quote"].alias("quote")))
    return rows.groupBy(by, "claim_id").agg(listed.alias("evidence"))


def rule_score(answer: Column, groups: Column, forbidden: Column) -> Column:
    """Whether an answer holds a term of each group and no forbidden one, white space and case aside."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    has = lambda term: F.contains(plain(answer), plain(term))
    return F.forall(groups, lambda g: F.exists(g, has)) & ~F.exists(forbidden, has)


def without_denials(answer: Column, term: Column) -> Column:
    """An answer less its denials of a term, which then doesn't count as said."""
    return F.regexp_replace(answer, F.concat(F.lit("(?:不是|并非|非)\\Q"), term, F.lit("\\E")), F.lit(""))


def nearest_rank(values: str, share: float) -> Column:
    """The value at place int(n * share + .999) of the sorted non-null values; percentile_disc keeps counts of values, not lists of rows.

    Its place, n * share rounded up, is the same wherever n * share is at least a thousandth above a whole number or at one.
    """
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {values})")


def majority(df: DataFrame, by: str, vote: str) -> DataFrame:
    """Each group's vote: 1 if at least half of the valid votes are 1; null without a valid one."""
    return df.groupBy(by).agg((F.avg(vote) >= 0.5).cast("int").alias("vote"), F.count(vote).alias("valid"))


def grade_distribution(df: DataFrame, by: list[str], grade: str, grades: int = 4) -> DataFrame:
    """Counts of every grade from 0, with zeros."""
    counts = df.groupBy(*by, grade).agg(F.count("*").alias("n"))
    every = df.select(*by).distinct().withColumn(grade, F.explode(F.sequence(F.lit(0), F.lit(grades - 1))))
    return every.join(counts, [*by, grade], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def paired_differences(rows: DataFrame, case: str, strategy: str, value: str, left: str, right: str) -> DataFrame:
    """case, difference for cases that both strategies have."""
    side = lambda s: rows.filter(F.col(strategy) == s).select(case, F.col(value).cast("double").alias(s))
    return side(left).join(side(right), case).select(case, (F.col(left) - F.col(right)).alias("difference"))


BOOTSTRAP = T.StructType([T.StructField("n", T.LongType()), T.StructField("delta", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("gains", T.BooleanType())])


def resampled_means(values: np.ndarray, draws: int, seed: int) -> list[float]:
    """Means of `draws` samples with replacement: those of random.Random(seed).choices() one after another, from the same generator in NumPy."""
    *key, pos = random.Random(seed).getstate()[1]
    rng, n = np.random.RandomState(), len(values)
    rng.set_state(("MT19937", np.array(key, dtype=np.uint32), pos))
    # sums of whole numbers are exact in any order
    whole = bool((values == np.floor(values)).all() and np.abs(values).max() * n < 2**53)
    picked = (values[(rng.random_sample(n) * n).astype(np.int64)] for _ in range(draws))
    return [(float(x.sum()) if whole else math.fsum(x)) / n for x in picked]


def paired_bootstrap(differences: DataFrame, by: str, case: str = "case", draws: int = 10_000, seed: int = 20261008) -> DataFrame:
    """by, n, delta, low, high (95 %), gains: resampled means of each comparison's differences, in case order.

    A comparison has a value a case, which is bounded by the test set, so one task holds it.
    """

    def draw(pdf):
        d = pdf.sort_values(case)["difference"].tolist()
        means = sorted(resampled_means(np.array(d, dtype=np.float64), draws, seed))
        low, high = means[int(draws * 0.025)], means[min(draws - 1, int(draws * 0.975))]
        return pdf.iloc[:1][[by]].assign(n=len(d), delta=statistics.fmean(d), low=low, high=high, gains=low > 0)

    schema = T.StructType([differences.schema[by], *BOOTSTRAP.fields])
    return differences.groupBy(by).applyInPandas(draw, schema)


def strategy_summary(rows: DataFrame, by: list[str], passed: str = "passed", degraded: str = "degraded", ms: str = "ms") -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col(passed)).alias("rule_passed"),
        F.count_if(F.col(passed) & ~F.col(degraded)).alias("normal_passed"),
        F.count_if(F.col(passed) & F.col(degraded)).alias("degraded_passed"),
        F.count_if(F.col(degraded)).alias("degraded"),
        F.count_if(F.col(ms).isNull()).alias("missing_ms"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {ms})").alias("p50_ms"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})").alias("p95_ms"),
        F.median(ms).alias("median_ms"),
    )


def choose_strategy(steps: list[dict], order: list[str]) -> str:
    """The strategy that a chain of comparisons settles on: each step names from, to, gains, critical (to and from), same and calls."""
    chosen = order[0]
    by = {(s["from"], s["to"]): s for s in steps}
    for candidate in order[1:]:
        s = by.get((chosen, candidate))
        if s and (s["gains"] and s["critical_to"] <= s["critical_from"] or s["same"] and s["critical_to"] == s["critical_from"] and s["calls_to"] < s["calls_from"]):
            chosen = candidate
    return chosen


def task_matrix(cases: DataFrame, strategies: list[str]) -> DataFrame:
    """Each case with each of a fixed list of strategies."""
    return cases.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))


def blind_ids(df: DataFrame, parts: list[str], salt: str, decisions: DataFrame | None = None, name: str = "blind_id") -> DataFrame:
    """Rows under stable blind ids, with earlier decisions kept."""
    out = df.withColumn(name, tx.digest(F.concat_ws("|", F.lit(salt), *[F.col(p).cast("string") for p in parts]), 24))
    return out if decisions is None else out.join(decisions, name, "left")


def journal_problems(journals: DataFrame, pool: DataFrame, key: str, journal: str, signature: str) -> DataFrame:
    """problem and key: pairs missing from, unknown to or shared between journals; and more than one signature."""
    j = journals.select(key, journal, signature)
    missing = pool.select(key).join(j, key, "left_anti").select(F.lit("missing").alias("problem"), F.col(key).cast("string").alias("key"))
    extra = j.join(pool, key, "left_anti").select(F.lit("extra"), F.col(key).cast("string")).distinct()
    shared = j.groupBy(key).agg(F.count_distinct(journal).alias("n")).filter("n > 1").select(F.lit("shared"), F.col(key).cast("string"))
    signatures = j.agg(F.count_distinct(signature).alias("n")).filter("n > 1").select(F.lit("signatures"), F.col("n").cast("string"))
    return missing.union(extra).union(shared).union(signatures)


def ledger(rows: DataFrame, phase: str, kinds: str, cap: int) -> DataFrame:
    """Attempts of each phase, over all kinds of a map column, against a cap."""
    total = F.aggregate(F.map_values(kinds), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy(phase).agg(F.sum(total).alias("attempts")).withColumn("within", F.col("attempts") <= cap)


def json_violations(raw: Column, schema: str, checks: list[tuple]) -> Column:
    """Names of the checks (functions of the parsed struct) that a JSON text fails; a text that can't be parsed fails `json`."""
    v = F.from_json(raw, schema)
    failed = [F.when(~F.coalesce(check(v), F.lit(False)), F.lit(name)) for name, check in checks]
    return F.when(F.try_parse_json(raw).isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*failed)))


def strict_object(raw: str | None, keys: set[str]) -> tuple[bool, list[str]]:
    """Whether a text is one JSON object with exactly these keys and none twice; used through strict_json."""
    import json

    problems: list[str] = []

    def pairs(items):
        names = [k for k, _ in items]
        if len(names) != len(set(names)):
            problems.append("duplicate_key")
        return dict(items)

    try:
        value = json.loads(raw or "", object_pairs_hook=pairs)
    except ValueError:
        return False, ["json"]
    if not isinstance(value, dict):
        return False, ["object"]
    if set(value) != keys:
        problems.append("keys")
    return not problems, problems


def strict_json(keys: set[str]):
    """Column function for strict_object (duplicate keys are lost to any parser of Spark's own)."""


    @F.pandas_udf("ok boolean, violations array<string>")
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([strict_object(x, keys) for x in raw], columns=["ok", "violations"])

    return run


def first_exclusion(answers: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """key and the first rule (by its order) whose pattern a text matches; rules: rule, rule_order, pattern (a small table)."""
    rows = answers.join(dimension(rules), F.expr(f"{text} RLIKE pattern"))
    return rows.groupBy(key).agg(F.min(F.struct("rule_order", "rule")).alias("x")).select(key, "x.rule")


#: Fixed value: the reason of claims that go because a step of their procedure was rejected.
REVALIDATE = "procedure_requires_revalidation"


def scoped_claims(claims: DataFrame, by: str, reason: str, instruction: str) -> DataFrame:
    """claims with their last reason: where an instruction of an answer was rejected, its other claims go too. A null reason is kept.

    claims: a row a claim, with the reason it was rejected for (or null) and whether it is an instruction (null: it isn't). Answers
    to be emptied are found by aggregation and joined, so that none is collected. A null `by` is an answer too.
    """
    broken = claims.filter(F.col(reason).isNotNull() & F.col(instruction)).select(F.col(by).alias("__by")).distinct()
    rows = claims.join(broken.withColumn("__broken", F.lit(True)), F.col(by).eqNullSafe(F.col("__by")), "left")
    return rows.withColumn(reason, F.coalesce(F.col(reason), F.when(F.col("__broken"), F.lit(REVALIDATE)))).drop("__by", "__broken")


def cited_scenes(answers: DataFrame, scenes: DataFrame, key: str, answer: str, scene: str, text: str) -> DataFrame:
    """key, pos, sentence, cited: each sentence less the [VID:..] tags of scenes that don't back it, and the distinct tags left, sorted.

    A tag holds if a scene of that name and key supports the sentence. Sentences meet only the scenes that they name.
    """
    s = answers.select(F.col(key).alias("__key"), F.posexplode(tx.answer_sentences(F.col(answer))).alias("pos", "sentence"))
    named = F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"\[VID:([A-Za-z0-9._:-]+)\]"), 1))
    tags = s.select("__key", "pos", "sentence", F.explode_outer(named).alias("tag"))
    e = scenes.select(F.col(key).alias("__of"), F.col(scene).cast("string").alias("__scene"), F.col(text).alias("__text"))
    hit = tags.join(e, (F.col("__key") == F.col("__of")) & (F.col("tag") == F.col("__scene")), "left")
    holds = F.coalesce(supported(tx.citation_tokens(F.col("sentence")), tx.citation_tokens(F.col("__text"))), F.lit(False))
    one = hit.groupBy("__key", "pos", "sentence", "tag").agg(F.max(holds).alias("ok"))
    g = one.groupBy("__key", "pos", "sentence").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("tag")))).alias("cited"), F.collect_list(F.when(~F.col("ok"), F.col("tag"))).alias("wrong"))
    bare = F.aggregate("wrong", F.col("sentence"), lambda t, w: F.replace(t, F.concat(F.lit("[VID:"), w, F.lit("]")), F.lit("")))
    return g.select(F.col("__key").alias(key), "pos", F.trim(F.regexp_replace(bare, r"[ \t]+([.!?。！？])", "$1")).alias("sentence"), "cited")


def bounded_evidence(hits: DataFrame, by: str, key: list[str], order: str, text: str, total: int = 6000) -> DataFrame:
    """First occurrences of each key in order, their texts cut where the sum of characters reaches the total."""
    first = hits.withColumn("__n", F.row_number().over(W.partitionBy(by, *key).orderBy(order))).filter(F.col("__n") == 1).drop("__n")
    before = F.sum(F.length(text)).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.length(text)
    rows = first.withColumn("__room", (F.lit(total) - before).cast("int")).filter((F.col("__room") > 0) & (F.length(text) > 0))
    return rows.withColumn(text, F.left(F.col(text), F.col("__room"))).drop("__room")


def picture_lines(pics: DataFrame, captions: DataFrame, by: str, most: int = 8, chars: int = 260) -> DataFrame:
    """by and lines about its pictures in order: repeats, noise and mismatches (but for tables) left out, long captions cut.

    pics: by, product, pos, pic; captions: product, pic, category, section_fit, short_caption, content.
    """
    first = pics.groupBy(by, "product", "pic").agg(F.min("pos").alias("pos"))
    rows = first.join(captions, ["product", "pic"]).filter("category <> 'noise' AND (coalesce(section_fit, '') <> 'mismatch' OR category = 'info_table')")
    short, full = F.trim(F.coalesce("short_caption", F.lit(""))), F.trim(F.coalesce("content", F.lit("")))
    said = F.when(full != "", full).otherwise(short)
    rows = rows.withColumn("said", F.when(F.length(said) > chars, F.concat(F.rtrim(F.left(said, F.lit(chars))), F.lit("..."))).otherwise(said)).filter("said <> ''")
    line = F.concat(F.lit("- [[PIC:"), F.col("pic"), F.lit("]] "), F.when(short != "", F.concat(short, F.lit(": "))).otherwise(""), F.col("said"))
    nth = F.row_number().over(W.partitionBy(by).orderBy("pos", "pic"))
    near = rows.withColumn("line", line).withColumn("nth", nth).filter(F.col("nth") <= most)
    return near.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def expanded_sections(hits: DataFrame, by: str, section: str, order: str, expand: int = 2) -> DataFrame:
    """hits plus expanded: whether its section is one of the most frequent of the group (equals: seen first)."""
    counts = hits.groupBy(by, section).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    best = counts.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("__n"), "__first"))).filter(F.col("__r") <= expand)
    return hits.join(best.select(by, section, F.lit(True).alias("expanded")), [by, section], "left").na.fill(False, ["expanded"])


def spans_of_claims(answers: DataFrame, claims: DataFrame, key: str, answer: str, claim: str) -> DataFrame:
    """key, pos, sentence, claim_no: sentences and the claim whose place in the answer holds them."""
    text = F.col(answer)
    s = answers.select(key, answer, F.posexplode(tx.sentences(text)).alias("pos", "sentence")).withColumn("at", F.expr(f"locate(sentence, {answer})"))
    c = claims.join(answers.select(key, answer), key).withColumn("from_", F.expr(f"locate({claim}, {answer})")).filter("from_ > 0")
    c = c.select(key, "claim_no", "from_", (F.col("from_") + F.length(claim)).alias("to_"))
    inside = (F.col("at") >= F.col("from_")) & (F.col("at") + F.length("sentence") <= F.col("to_"))
    rows = s.join(c, key, "left").withColumn("claim_no", F.when(inside, F.col("claim_no")))
    return rows.groupBy(key, "pos", "sentence").agg(F.min("claim_no").alias("claim_no"))


def needs_revision(question: Column, answer: Column, scenes: Column, asks: str, refuses: str) -> Column:
    """Whether an answer is to be revised: there are scenes, and the question asks for what is seen, or the answer refuses or cites none of them."""
    cites = F.exists(scenes, lambda s: F.contains(answer, F.concat(F.lit("[VID:"), s, F.lit("]"))))
    return (F.size(scenes) > 0) & (question.rlike(asks) | answer.rlike(refuses) | ~cites)
