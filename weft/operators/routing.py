"""Routing of questions to products by tables of names, aliases, phrases and votes.

All tables about products are given by the caller. They are dimensions: sent to the tasks if their
bytes allow it, and joined as they are otherwise. Names and phrases are looked for by containment,
so each question is held against each row of a dimension, as a question names any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators import lexical, ranking

#: Bytes of a dimension that may be sent to every task.
MAX_DIMENSION_BYTES = 64 << 20
# What a manual's name ends with, scores of the voting stages.
SUFFIX = "手册"
BONUS, LEAST_SCORE, CLEAR_SCORE, CLEAR_GAP, NEAR, LOW = 0.35, 1.5, 3.0, 1.0, 1.5, 5.0


def dimension(df: DataFrame, otherwise: str = "shuffle_replicate_nl") -> DataFrame:
    """df, to be broadcast if its strings take few enough bytes. If not, neither side of its join is sent whole: it is joined as `otherwise` hints (by pairs of parts, for conditions other than equality)."""
    strings = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16 for f in df.schema.fields]
    total = strings[0]
    for s in strings[1:]:
        total = total + s
    return F.broadcast(df) if (df.agg(F.sum(total)).first()[0] or 0) <= MAX_DIMENSION_BYTES else df.hint(otherwise)


def normalised_name(product: Column) -> Column:
    return F.trim(F.replace(F.lower(product), F.lit(SUFFIX), F.lit("")))


def alias_list(product: Column, given: Column) -> Column:
    """All aliases of a product, longest first: its name, the name before the suffix, those given, each also in lower case."""
    plain = F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    short = F.array_compact(F.array(F.regexp_extract(product, f"^(.*){SUFFIX}$", 1)))
    base = F.concat(F.array(product), F.filter(short, lambda s: s != ""), plain)
    every = F.array_distinct(F.flatten(F.transform(base, lambda a: F.array(a, F.lower(a)))))
    keyed = F.array_sort(F.transform(every, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))
    return F.transform(keyed, lambda x: x["a"])


def alias_document(product: Column, aliases: Column) -> Column:
    """What the fallback router searches: the name once, the aliases twice."""
    said = F.array_join(aliases, " ")
    return F.trim(F.concat_ws("\n", product, said, said))


def _quoted(text: str) -> str:
    return f"concat('\\\\Q', {text}, '\\\\E')"


def display_matches(questions: DataFrame, names: DataFrame, question: str = "question", key: str = "q") -> DataFrame:
    """key, product, length: products whose name stands in a question as whole words, or without its blanks; ideographic names anywhere.

    names: product, name, and optionally unless and but (patterns: the product is left out where the first is found and the second isn't).
    """
    n = names.withColumn("__low", F.lower(F.trim("name"))).filter("__low <> ''")
    for c in ("unless", "but"):
        if c not in n.columns:
            n = n.withColumn(c, F.lit(None).cast("string"))
    low = "__said"
    # a pattern made of a column is compiled for every pair, so it is only asked where the name stands at all
    word = lambda x: f"contains({low}, {x}) AND {low} RLIKE concat('(?<![a-z0-9])', {_quoted(x)}, '(?![a-z0-9])')"
    ideographic = "__low RLIKE '[一-鿿]'"
    compact = "replace(__low, ' ', '')"
    length = F.expr(f"CASE WHEN {ideographic} THEN CASE WHEN contains({question}, trim(name)) THEN length(__low) END WHEN {word('__low')} THEN length(__low) WHEN contains(__low, ' ') AND {word(compact)} THEN length({compact}) END")
    out = F.expr(f"coalesce({low} RLIKE unless AND NOT coalesce({low} RLIKE but, false), false)")
    rows = questions.withColumn(low, F.lower(question)).join(dimension(n), length.isNotNull() & ~out).withColumn("length", length)
    return rows.groupBy(key, "product").agg(F.max("length").alias("length"))


def phrase_matches(questions: DataFrame, phrases: DataFrame, question: str = "question", key: str = "q") -> DataFrame:
    """key, product: the first phrase (by place) that a question holds. phrases: place, phrase, product."""
    hit = F.contains(F.lower(F.col(question)), F.col("phrase"))
    return questions.join(dimension(phrases), hit).groupBy(key).agg(F.min(F.struct("place", "product")).alias("x")).select(key, F.col("x.product").alias("product"))


def nickname_matches(questions: DataFrame, patterns: DataFrame, question: str = "question", key: str = "q") -> DataFrame:
    """key, product, length: the longest first match of a product's patterns in the lower-cased question. patterns: product, pattern."""
    rows = questions.join(dimension(patterns), F.expr(f"lower({question}) RLIKE pattern"))
    return rows.groupBy(key, "product").agg(F.max(F.length(F.expr(f"regexp_extract(lower({question}), pattern, 0)"))).alias("length"))


def alias_matches(questions: DataFrame, aliases: DataFrame, weak: list[str], question: str = "question", key: str = "q") -> DataFrame:
    """key, product, alias, length, exact: the longest alias of each product that a question holds, weak ones aside. aliases: product, alias."""
    a = aliases.withColumn("alias", F.lower("alias")).filter((F.col("alias") != "") & ~F.col("alias").isin(weak)).distinct()
    rows = questions.join(dimension(a), F.contains(F.lower(F.col(question)), F.col("alias")))
    best = rows.groupBy(key, "product").agg(F.max(F.struct(F.length("alias").alias("length"), "alias")).alias("x"))
    return best.select(key, "product", "x.alias", "x.length", (F.col("x.alias") == F.lower("product")).alias("exact"))


def _in_order(rows: DataFrame, key: str, order: list[Column], name: str, most: int | None = None, **first: str) -> DataFrame:
    """key and the products of a stage as an array, best first; first: columns with the best row's value of another (name=column)."""
    rows = ranking.ranked(rows, [key], [*order, F.col("product")], "__n")
    if most:
        rows = rows.filter(F.col("__n") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__n", "product"))), lambda x: x["product"])
    return rows.groupBy(key).agg(listed.alias(name), *[F.min_by(c, "__n").alias(n) for n, c in first.items()])


def route(questions: DataFrame, display: DataFrame, functional: DataFrame, nicknames: DataFrame, grep: DataFrame, named: DataFrame, votes: DataFrame, generic: list[str], fallback: DataFrame | None = None, top: int = 3, key: str = "q") -> DataFrame:
    """key, reason, confidence, products: the first stage that decides.

    A displayed name, alone or beside another product's functional phrase; a functional phrase; a
    nickname; a phrase that one manual alone holds; aliases and votes of the content, agreeing (a
    generic alias with less confidence) or not; either alone; the fallback's own decision.
    The tables are those of the functions above, grep: key, product; votes: key, product, votes.
    """
    # every side has a row for nearly each question: sorted, not sent to all, however small the files they come from
    side = lambda df: df.hint("merge")
    rows = questions.select(key)
    rows = rows.join(side(_in_order(display, key, [F.desc("length")], "shown")), key, "left")
    rows = rows.join(side(functional.withColumnRenamed("product", "functional")), key, "left")
    rows = rows.join(side(_in_order(nicknames, key, [F.desc("length")], "nick")), key, "left")
    rows = rows.join(side(grep.select(key, F.col("product").alias("grep"))), key, "left")
    rows = rows.join(side(_in_order(named, key, [F.desc("exact"), F.desc("length")], "names", by="alias")), key, "left")
    rows = rows.join(side(_in_order(votes, key, [F.desc("votes")], "content", top)), key, "left")
    none = F.array().cast("array<string>")
    first = lambda c: F.slice(c, 1, 1)
    merged = lambda n: F.slice(F.array_distinct(F.concat(first("names"), F.slice("content", 1, n))), 1, top)
    shown, names, content, other = F.col("shown").isNotNull(), F.col("names").isNotNull(), F.col("content").isNotNull(), F.col("functional")
    agree = F.array_contains("content", F.get("names", F.lit(0)))
    stages = [
        (shown & other.isNotNull() & (other != F.get("shown", F.lit(0))), "display_vs_functional_divergence", "medium", F.concat(first("shown"), F.array(other))),
        (shown, "explicit_product_name", "high", first("shown")),
        (other.isNotNull(), "functional_alias", "medium", F.array(other)),
        (F.col("nick").isNotNull(), "explicit_product_nickname", "high", first("nick")),
        (F.col("grep").isNotNull(), "phrase_grep_unique", "high", F.array("grep")),
        (names & content & agree & F.col("by").isin(generic), "generic_alias_agree", "medium", merged(top)),
        (names & content & agree, "name_and_content_agree", "high", first("names")),
        (names & content, "name_vs_content_divergence", "medium", merged(max(top - 1, 0))),
        (names, "alias_or_name_match", "high", F.slice("names", 1, top)),
        (content, "content_vote_only", "medium", F.slice("content", 1, top)),
    ]
    if fallback is not None:
        rows = rows.join(side(fallback.select(key, F.col("confidence").alias("__c"), F.col("products").alias("__p"))), key, "left")
        stages.append((F.col("__c").isNotNull(), "bm25_router", F.col("__c"), F.col("__p")))
    reason, confidence, products = F.lit("no_positive_score"), F.lit("none"), none
    for test, name, sure, chosen in reversed(stages):
        reason = F.when(test, F.lit(name)).otherwise(reason)
        confidence = F.when(test, sure if isinstance(sure, Column) else F.lit(sure)).otherwise(confidence)
        products = F.when(test, chosen).otherwise(products)
    return rows.select(key, reason.alias("reason"), confidence.alias("confidence"), products.alias("products"))


def router_scores(questions: DataFrame, documents: DataFrame, tokens, question: str = "question", key: str = "q") -> DataFrame:
    """key, product, score: BM25 over short documents of names, plus BONUS for each shared token; valid with two shared tokens or one of three characters.

    documents: product, text.
    """
    found = lexical.bm25(documents, questions, tokens(F.col("text")), tokens(F.col(question)), doc_id="product", query_id=key)
    shared = documents.select("product", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t")).join(questions.select(key, F.explode(F.array_distinct(tokens(F.col(question)))).alias("t")), "t")
    shared = shared.groupBy(key, "product").agg(F.count("*").alias("n"), F.max(F.length("t")).alias("longest")).filter("n >= 2 OR longest >= 3")
    rows = found.withColumnsRenamed({"query": key, "doc": "product"}).join(shared, [key, "product"])
    return rows.withColumn("score", F.round(F.col("score") + BONUS * F.col("n"), 6)).filter("score > 0").select(key, "product", "score")


def router_decision(scores: DataFrame, top: int = 3, key: str = "q") -> DataFrame:
    """key, confidence, products, best, gap: what the fallback's scores are worth; three near and low scores decide nothing."""
    rows = ranking.ranked(scores, [key], [F.desc("score"), F.col("product")], "n").filter(F.col("n") <= max(top, 3))
    listed = F.array_sort(F.collect_list(F.struct("n", "product", "score")))
    rows = rows.groupBy(key).agg(listed.alias("s"))
    at = lambda i: F.coalesce(F.get("s", F.lit(i))["score"], F.lit(0.0))
    best, gap = at(0), at(0) - at(1)
    last = F.when(F.size("s") >= 3, at(2)).otherwise(at(1))
    vague = (F.size("s") >= 2) & (best - last < NEAR) & (best < LOW)
    clear = (best >= CLEAR_SCORE) & (gap >= CLEAR_GAP)
    near = F.slice(F.transform(F.filter("s", lambda x: x["score"] >= F.greatest(F.lit(1.0), best * 0.7)), lambda x: x["product"]), 1, top)
    none = F.array().cast("array<string>")
    products = F.when(vague, none).when(clear, F.array(F.get("s", F.lit(0))["product"])).when(best >= LEAST_SCORE, near).otherwise(none)
    confidence = F.when(vague, "none").when(clear, "high").when(best >= LEAST_SCORE, "medium").otherwise("none")
    return rows.select(key, confidence.alias("confidence"), products.alias("products"), F.round(best, 6).alias("best"), F.round(gap, 6).alias("gap"))


def content_scores(questions: DataFrame, documents: DataFrame, classes: DataFrame, aliases: DataFrame, tokens, stop: list[str], question: str = "question", key: str = "q") -> DataFrame:
    """key, product, doc, score: BM25 of a question's words that no alias of its products and no stop word holds, over those products' documents.

    documents: doc, product, text; classes: key, product (what a question is about); aliases: product, alias.
    """
    named = F.array_distinct(F.flatten(F.collect_list(tokens(F.concat_ws(" ", "product", "alias")))))
    left_out = classes.join(aliases, "product").groupBy(key).agg(named.alias("named"))
    asked = questions.join(left_out, key).withColumn("t", F.filter(F.filter(tokens(F.col(question)), lambda t: ~F.array_contains("named", t)), lambda t: ~t.isin(stop)))
    about = documents.join(classes.select("product").distinct(), "product", "left_semi")
    found = lexical.bm25(documents, asked, tokens(F.col("text")), F.col("t"), doc_id="doc", query_id=key, among=about, places=6, group="product")
    return found.withColumnsRenamed({"query": key}).join(classes, [key, "product"], "left_semi").select(key, "product", "doc", "score")


def locked_product(reason: Column, products: Column) -> Column:
    """The product that a name or nickname alone decided; null otherwise."""
    return F.when(reason.isin("explicit_product_name", "explicit_product_nickname") & (F.size(products) == 1), F.get(products, F.lit(0)))


def primary_product(products: Column) -> Column:
    return F.get(products, F.lit(0))


def rule_route(question: Column, service: str, technical: str) -> Column:
    """service where its pattern alone matches, else tech."""
    return F.when(question.rlike(service) & ~question.rlike(technical), "service").otherwise("tech")


def dual_rerank(candidates: DataFrame, by_keywords: DataFrame, by_question: DataFrame, parents: DataFrame, item: str = "doc", key: str = "query", rank: str = "rank", first: int = 6, second: int = 4, top: int = 8) -> DataFrame:
    """key, item, place: the best by the keywords' scores, then the best by the question's own, one for each parent, cut at top.

    candidates: key, item, rank; scores: key, item, score, for any part of the candidates (the rest follows in its order);
    parents: item, parent. A question that equals the keywords has no scores of its own.
    """
    lists = []
    for n, (scores, most) in enumerate(((by_keywords, first), (by_question, second))):
        asked = candidates if n == 0 else candidates.join(scores.select(key).distinct(), key, "left_semi")
        best = ranking.rerank_or_fallback(asked, scores, [key], item, rank, most)
        lists.append(best.select(key, item, (F.col("final_rank") + n * first).alias("at")))
    rows = lists[0].unionByName(lists[1]).join(parents, item)
    once = ranking.first_per_key(rows, [key], ["parent"], [F.col("at")])
    return ranking.ranked(once, [key], [F.col("at")], "place").filter(F.col("place") <= top).select(key, item, "place")


def keyword_recall(scores: DataFrame, each: int = 5, key: str = "query", keyword: str = "keyword", item: str = "doc") -> DataFrame:
    """key, item, pos: the best items of every keyword, keyword after keyword, first occurrences only. scores: key, place, keyword, item, score."""
    near = ranking.top_k(scores, [key, "place", keyword], "score", item, each, "nth")
    first = near.groupBy(key, item).agg(F.min(F.struct("place", "nth")).alias("at"))
    return ranking.ranked(first, [key], [F.col("at"), F.col(item)], "pos").drop("at")


def fresh_hits(hits: DataFrame, session: str, turn: str, order: str, product: str, heading: str, text: str) -> DataFrame:
    """Hits of a session whose product, heading and text (white space folded) no earlier hit has."""
    fold = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    mark = F.sha2(F.concat_ws("\n", F.trim(F.coalesce(F.col(product), F.lit(""))), fold(heading), fold(text)), 256)
    w = W.partitionBy(session, "__mark").orderBy(turn, order)
    return hits.withColumn("__mark", mark).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__mark")
