"""Answers and summaries of models against their contracts, as rows.

A reply is JSON text. It is read once as a variant, which keeps booleans, integers and texts apart and
refuses repeated keys; its claims (or entries) and their references become rows, and references meet the sources they name
in a join. Every check is a predicate of its row: the first that fails, in the order of reply, claim and
reference, is the reply's problem, found by a minimum over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a reply, of its assessment and of its parts, sizes of their texts, and what a claim's text must not hold.
REPLY, ASSESSED = ("claims", "insufficient"), ("assessment", "claims", "insufficient")
ASSESSMENT, PLANNED = ("answerability", "reason", "requested_task"), ("answerability", "missing_parts", "reason", "requested_task", "required_conditions")
ANSWERABILITY = ("complete", "partial", "none")
CLAIM, REFERENCE = ("evidence", "text", "verdict"), ("quote", "source_id")
REPLY_CHARS, TASK_CHARS, TEXT_CHARS, NOTE_CHARS, SOURCE_CHARS, QUOTE_CHARS = 32_000, 800, 1200, 400, 200, 3000
REFERENCES, NOTES = 8, 8
MARKUP = r"\[\[|<PIC|\n\s*\n|^\s*#"
SUMMARY_FIELDS = ("current_goal", "equipment", "constraints", "confirmed_symptoms", "attempted_actions", "open_questions", "unverified_assistant_advice")
ENTRIES, CITATIONS = 20, 5

Check = tuple[str, Column]


def at(v: Column, path: str, kind: str) -> Column:
    """A part of a variant as this type; null if it is missing or of another kind."""
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, path: str) -> Column:
    return F.split(F.schema_of_variant(at(v, path, "variant")), "<")[0]


def keys_are(v: Column, names: tuple[str, ...]) -> Column:
    return F.array_sort(F.map_keys(at(v, "$", "map<string,variant>"))) == F.array(*map(F.lit, names))


def text_at(v: Column, path: str, most: int) -> Column:
    """Whether there is a text that isn't blank nor longer than this."""
    t = at(v, path, "string")
    return (kind_of(v, path) == "STRING") & (F.trim(F.regexp_replace(t, r"\s", " ")) != "") & (F.length(t) <= most)


def first(checks: list[Check]) -> Column:
    """The problem of the first check that doesn't hold, or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(problem)) for problem, ok in checks])


def read(replies: DataFrame, key: str, raw: str) -> DataFrame:
    """key, v (the variant, null if there is none) and problem (of the text itself)."""
    text = F.col(raw)
    v = F.try_parse_json(text)
    problem = F.when(text.isNull() | (F.length(text) > REPLY_CHARS), "size").when(v.isNull(), F.when(F.get_json_object(text, "$").isNull(), "json").otherwise("duplicate key"))
    return replies.select(F.col(key).alias("key"), F.when(problem.isNull(), v).alias("v"), problem.alias("broken"))


def parts(rows: DataFrame, v: str, path: str, number: str, out: str) -> DataFrame:
    """A row for each element of a list in a variant."""
    return rows.select(*[c for c in rows.columns if c != v], F.posexplode(at(F.col(v), path, "array<variant>")).alias(number, out))


def _notes(a: Column, field: str) -> Column:
    notes = at(a, f"$.{field}", "array<variant>")
    text = F.transform(notes, lambda n: F.when((F.schema_of_variant(n) == "STRING"), F.try_variant_get(n, "$", "string")))
    fine = F.forall(text, lambda t: F.coalesce((F.trim(t) != "") & (F.length(t) <= NOTE_CHARS), F.lit(False)))
    return (F.size(notes) <= NOTES) & fine & (F.size(F.array_distinct(text)) == F.size(notes))


def reply_checks(v: Column, most: int) -> list[Check]:
    rated = F.coalesce(F.array_contains(F.map_keys(at(v, "$", "map<string,variant>")), "assessment"), F.lit(False))
    a, claims, short = at(v, "$.assessment", "variant"), at(v, "$.claims", "array<variant>"), at(v, "$.insufficient", "boolean")
    planned = rated & F.coalesce(kind_of(a, "$.missing_parts").isNotNull() | kind_of(a, "$.required_conditions").isNotNull(), F.lit(False))
    grade, whole = at(a, "$.answerability", "string"), at(a, "$.answerability", "string") == "complete"
    return [
        ("keys", F.when(rated, keys_are(v, ASSESSED)).otherwise(keys_are(v, REPLY))),
        ("types", (kind_of(v, "$.insufficient") == "BOOLEAN") & (kind_of(v, "$.claims") == "ARRAY")),
        ("number of claims", (F.size(claims) <= most) & ((F.size(claims) > 0) | short)),
        ("keys", ~rated | F.when(planned, keys_are(a, PLANNED)).otherwise(keys_are(a, ASSESSMENT))),
        ("text", ~rated | (text_at(a, "$.requested_task", TASK_CHARS) & text_at(a, "$.reason", TEXT_CHARS))),
        ("answerability", ~rated | ((kind_of(a, "$.answerability") == "STRING") & grade.isin(*ANSWERABILITY))),
        ("missing_parts", ~planned | _notes(a, "missing_parts")),
        ("required_conditions", ~planned | _notes(a, "required_conditions")),
        ("missing parts of a complete answer", ~planned | ~whole | (F.size(at(a, "$.missing_parts", "array<variant>")) == 0)),
        ("insufficiency", ~rated | (short != whole)),
        ("claims without an answer", ~rated | (grade != "none") | (F.size(claims) == 0)),
    ]


def claim_checks(c: Column) -> list[Check]:
    refs = at(c, "$.evidence", "array<variant>")
    return [
        ("keys", keys_are(c, CLAIM)),
        ("verdict", at(c, "$.verdict", "string") == "supported"),
        ("text", text_at(c, "$.text", TEXT_CHARS)),
        ("markup", ~at(c, "$.text", "string").rlike(MARKUP)),
        ("evidence", (kind_of(c, "$.evidence") == "ARRAY") & F.size(refs).between(1, REFERENCES)),
    ]


def _references(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """key, claim, ref, source, quote, fine (shape), found (the quote stands in the source), nth (of its source within the claim, from 1)."""
    r = parts(claims, "c", "$.evidence", "ref", "r")
    r = r.select("key", "claim", "ref", "r", at(F.col("r"), "$.source_id", "string").alias("source"), at(F.col("r"), "$.quote", "string").alias("quote"))
    fine = first([("keys", keys_are(F.col("r"), REFERENCE)), ("text", text_at(F.col("r"), "$.source_id", SOURCE_CHARS) & text_at(F.col("r"), "$.quote", QUOTE_CHARS))])
    s = sources.select(F.col("key").alias("of"), F.col("source").alias("name"), F.col("text").alias("held"))
    near = r.withColumn("shape", fine).join(s, (F.col("key") == F.col("of")) & (F.col("source") == F.col("name")), "left")
    # a claim has few references: their sources' first places tell repeats
    seen = r.groupBy("key", "claim", "source").agg(F.min("ref").alias("first"))
    near = near.withColumn("found", F.coalesce(F.contains("held", "quote"), F.lit(False))).join(seen, ["key", "claim", "source"], "left")
    return near.select("key", "claim", "ref", "source", "quote", "shape", "found", (F.col("ref") == F.col("first")).alias("fresh"))


def _claims(v: DataFrame) -> DataFrame:
    return parts(v.filter("v IS NOT NULL"), "v", "$.claims", "claim", "c").select("key", "claim", "c")


def checked(replies: DataFrame, sources: DataFrame, key: str, raw: str, most: int = 6) -> DataFrame:
    """key, ok, problem for each reply: whether its claims are supported, plain and quoted from the reply's sources, none twice.

    sources: key (the reply's), source, text; a source that is given twice for a reply raises no problem if either holds the quote.
    Replies with the same key are one: any problem of theirs counts. A null key is a key.
    """
    v = read(replies.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\0"))), "__key", raw)
    none = F.lit(-1)
    top = v.select("key", none.alias("claim"), none.alias("ref"), F.coalesce("broken", first(reply_checks(F.col("v"), most))).alias("problem"))
    c = _claims(v)
    mid = c.select("key", "claim", none.alias("ref"), first(claim_checks(F.col("c"))).alias("problem"))
    mine = sources.select(F.coalesce(F.col("key").cast("string"), F.lit("\0")).alias("key"), "source", "text")
    r = _references(c, mine).groupBy("key", "claim", "ref").agg(F.first("shape", True).alias("shape"), F.max("found").alias("found"), F.max("fresh").alias("fresh"))
    low = r.select("key", "claim", "ref", F.coalesce("shape", F.when(~(F.col("found") & F.coalesce("fresh", F.lit(False))), "reference")).alias("problem"))
    worst = top.unionByName(mid).unionByName(low).groupBy("key").agg(F.min(F.when(F.col("problem").isNotNull(), F.struct("claim", "ref", "problem"))).alias("x"))
    keys = replies.select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("__key")).distinct()
    return keys.join(worst.withColumnRenamed("key", "__key"), "__key").select(key, F.col("x").isNull().alias("ok"), F.col("x.problem").alias("problem"))


def claims(replies: DataFrame, key: str, raw: str) -> DataFrame:
    """key, claim, text, evidence (source, quote) of replies that are within their contract."""
    c = _claims(read(replies, key, raw))
    ref = F.transform(at(F.col("c"), "$.evidence", "array<variant>"), lambda r: F.struct(F.try_variant_get(r, "$.source_id", "string").alias("source"), F.try_variant_get(r, "$.quote", "string").alias("quote")))
    return c.select(F.col("key").alias(key), "claim", at(F.col("c"), "$.text", "string").alias("text"), ref.alias("evidence"))


def summary_checks(v: Column) -> list[Check]:
    lists = [(kind_of(v, f"$.{f}") == "ARRAY") & (F.size(at(v, f"$.{f}", "array<variant>")) <= ENTRIES) for f in SUMMARY_FIELDS]
    every, some = lists[0], F.size(at(v, f"$.{SUMMARY_FIELDS[0]}", "array<variant>"))
    for f, ok in zip(SUMMARY_FIELDS[1:], lists[1:], strict=True):
        every, some = every & ok, some + F.size(at(v, f"$.{f}", "array<variant>"))
    return [("keys", keys_are(v, tuple(sorted(SUMMARY_FIELDS)))), ("list", every), ("empty", some > 0)]


def summaries(replies: DataFrame, turns: DataFrame, key: str, raw: str, budget: int) -> DataFrame:
    """key, ok, problem, text: structured summaries whose entries quote the session's own turns, as lines within a budget of bytes.

    turns: key, turn_id, question, answer. The last field holds the assistant's words, the others users'. Entries are taken whole,
    in order, those that don't fit are passed over; a summary that keeps none has the problem `budget`.
    """
    v = read(replies, key, raw)
    top = v.select("key", F.lit(-1).alias("field"), F.lit(-1).alias("entry"), F.lit(-1).alias("ref"), F.coalesce("broken", first(summary_checks(F.col("v")))).alias("problem"))
    lists = F.array(*[F.struct(F.lit(i).alias("field"), F.lit(f).alias("name"), at(F.col("v"), f"$.{f}", "array<variant>").alias("list")) for i, f in enumerate(SUMMARY_FIELDS)])
    e = v.filter("v IS NOT NULL").select("key", F.explode(lists).alias("l")).select("key", "l.field", "l.name", F.posexplode("l.list").alias("entry", "e"))
    cited = at(F.col("e"), "$.sources", "array<variant>")
    shape = [("keys", keys_are(F.col("e"), ("sources", "text"))), ("text", text_at(F.col("e"), "$.text", REPLY_CHARS)), ("sources", (kind_of(F.col("e"), "$.sources") == "ARRAY") & F.size(cited).between(1, CITATIONS))]
    mid = e.select("key", "field", "entry", F.lit(-1).alias("ref"), first(shape).alias("problem"))
    role = F.when(F.col("field") == len(SUMMARY_FIELDS) - 1, "assistant").otherwise("user")
    r = parts(e.select("key", "field", "name", "entry", at(F.col("e"), "$.text", "string").alias("text"), "e"), "e", "$.sources", "ref", "r").withColumn("role", role)
    r = r.withColumn("turn", F.when(kind_of(F.col("r"), "$.turn_id") == "BIGINT", at(F.col("r"), "$.turn_id", "bigint"))).withColumn("quote", at(F.col("r"), "$.quote", "string"))
    t = turns.select(F.col(key).alias("of"), F.col("turn_id").cast("long").alias("id"), "question", "answer")
    near = r.join(t, (F.col("key") == F.col("of")) & (F.col("turn") == F.col("id")), "left")
    known = F.col("id").isNotNull() & (at(F.col("r"), "$.role", "string") == F.col("role"))
    held = F.contains(F.when(F.col("role") == "user", F.col("question")).otherwise(F.col("answer")), F.col("quote"))
    low = near.select("key", "field", "entry", "ref", first([("keys", keys_are(F.col("r"), ("quote", "role", "turn_id"))), ("role or turn", known), ("quote", text_at(F.col("r"), "$.quote", REPLY_CHARS) & held)]).alias("problem"))
    worst = top.unionByName(mid).unionByName(low).groupBy("key").agg(F.min(F.when(F.col("problem").isNotNull(), F.struct("field", "entry", "ref", "problem"))).alias("x"))
    shown = F.concat(F.lit("[turn="), F.col("turn").cast("string"), F.lit("; "), F.col("role"), F.lit("] "), F.col("quote"))
    line = F.concat(F.first("name"), F.lit(": "), F.first("text"), F.lit(" "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", shown.alias("s")))), lambda x: x["s"]), " "))
    lines = near.groupBy("key", "field", "entry").agg(line.alias("line")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "entry", "line"))), lambda x: x["line"]).alias("lines"))
    # a summary has at most ENTRIES lines a field, so the fold is over few
    cost = lambda a, x: F.octet_length(a) + F.octet_length(x) + F.when(a == "", 0).otherwise(1)
    text = F.aggregate("lines", F.lit(""), lambda a, x: F.when(cost(a, x) <= budget, F.when(a == "", x).otherwise(F.concat(a, F.lit("\n"), x))).otherwise(a))
    out = worst.join(lines.select("key", text.alias("text")), "key", "left")
    problem = F.coalesce("x.problem", F.when(F.coalesce("text", F.lit("")) == "", "budget"))
    return out.select(F.col("key").alias(key), problem.isNull().alias("ok"), problem.alias("problem"), F.when(problem.isNull(), F.col("text")).alias("text"))
