"""What a search tool said, read back from its text: hits, tags, counters, and whether they fit the product asked for.

A text is read as lines. A line that heads a hit begins it; the lines up to the next head are its fields and,
from the line that opens it on, its content. Lines travel by text once. A null text says nothing: it has no
hits and is no result. Blanks at the ends of lines and around a content don't count; a line within a content that
looks like a head is one, as the format has no escapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import text as tx

# The format's line patterns and marks.
HIT = r"^\s*\[(\d+)\]\s+产品:\s+(.*?)\s+\|\s+章节:\s+(.*)$"
FULL = r"^\s*\[SECTION_FULL\]\s+产品:\s+(.*?)\s+\|\s+章节ID:\s+(\d+)\s+\|\s+章节:\s+(.*)$"
PRODUCT = r"^产品: (.*)$"
HEADING = r"^\s*章节:\s+\[\d+\]\s+(.*)$"
TAG = r"^\s*\[([A-Z_]+)\]\s+(.*)$"
OPENS, WHOLE, PARENT, SUMMARY = "内容:", "完整章节正文:", "上层章节ID:", "上层摘要:"
AUXILIARY, NOTHING, NOT_FOUND, NO_RESULT = "图片内容标注（", "(无检索结果)", "未找到 ", "no_result"


def rendered(hits: DataFrame, key: str) -> DataFrame:
    """key, text: the hits of each key in the format, by rank. hits: rank, product, heading, section_id, content."""
    one = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] 产品: "), F.col("product"), F.lit(" | 章节: "), F.col("heading"), F.lit(f"\n{PARENT} "), F.col("section_id").cast("string"), F.lit(f"\n{OPENS} "), F.coalesce("content", F.lit(""))
    )
    return hits.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("text")))), lambda x: x["text"]), "\n").alias("text"))


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line, head (whether it begins a hit), hit (0 before the first)."""
    rows = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    rows = rows.withColumn("head", F.col("line").rlike(HIT) | F.col("line").rlike(FULL))
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("hit", F.sum(F.col("head").cast("int")).over(upto))


def _part(pattern: str, group: int) -> Column:
    return F.trim(F.regexp_extract("line", pattern, group))


def _field(rows: Column, mark: str) -> Column:
    """What the last line of a mark says."""
    return F.trim(F.substring(F.try_element_at(F.filter(rows, lambda x: x.startswith(mark)), F.lit(-1)), len(mark) + 1, 1 << 30))


def hits(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, rank, product, heading, section_id (text), summary, content, pics: the hits of each text. `key` is unique."""
    full = F.col("line").rlike(FULL)
    rank = F.when(full, F.col("hit").cast("long")).otherwise(_part(HIT, 1).try_cast("long"))
    head = F.struct(
        rank.alias("rank"),
        F.when(full, _part(FULL, 1)).otherwise(_part(HIT, 2)).alias("product"),
        F.when(full, _part(FULL, 3)).otherwise(_part(HIT, 3)).alias("heading"),
        F.when(full, _part(FULL, 2)).alias("section_id"),
    )
    rows = lines(texts, key, text).filter("hit > 0")
    g = rows.groupBy(key, "hit").agg(F.max(F.when(F.col("head"), head)).alias("h"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("l"))
    g = g.withColumn("l", F.transform("l", lambda x: x["line"]))
    opens = F.array_position(F.transform("l", lambda x: F.trim(x).startswith(OPENS) | (F.trim(x) == WHOLE)), True)
    g = g.withColumn("at", opens.cast("int"))
    before = F.transform(F.when(F.col("at") > 0, F.slice("l", 1, F.col("at") - 1)).otherwise(F.col("l")), lambda x: F.trim(x))
    first = F.trim(F.try_element_at("l", F.greatest("at", F.lit(1))))
    after = F.slice("l", F.col("at") + 1, F.size("l"))
    said = F.array_join(F.concat(F.when(first == WHOLE, F.array().cast("array<string>")).otherwise(F.array(F.trim(F.substring(first, len(OPENS) + 1, 1 << 30)))), after), "\n")
    content = F.when(F.col("at") > 0, _strip(F.substring_index(said, AUXILIARY, 1)))
    return g.select(key, "h.rank", "h.product", "h.heading", F.coalesce(_field(before, PARENT), F.col("h.section_id")).alias("section_id"), _field(before, SUMMARY).alias("summary"), content.alias("content")).withColumn(
        "pics", tx.picture_names(F.coalesce("content", F.lit("")))
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def observed(texts: DataFrame, key: str, text: str, stated: str | None = None) -> DataFrame:
    """key, status, reason, filtered, no_result, products, headings (how many lines name one), dominant_product, dominant_count, conflict.

    The dominant product is named by most lines, of equal ones by the first. It conflicts if at least two lines name it and `stated`,
    the one product asked for, is another. Tags count where they stand first; `filtered` is null unless it is a number. `key` is unique.
    """
    rows = lines(texts, key, text)
    named = F.coalesce(*[F.nullif(F.regexp_extract("line", p, n), F.lit("")) for p, n in ((HIT, 2), (PRODUCT, 1))])
    titled = F.coalesce(*[F.nullif(F.regexp_extract("line", p, n), F.lit("")) for p, n in ((HIT, 3), (HEADING, 1))])
    rows = rows.select(key, "pos", F.trim(named).alias("product"), titled.isNotNull().alias("titled"), F.regexp_extract("line", TAG, 1).alias("tag"), F.trim(F.regexp_extract("line", TAG, 2)).alias("value"))
    light = rows.groupBy(key, "product").agg(
        F.count("*").alias("n"),
        F.min("pos").alias("first"),
        F.count_if("titled").alias("titled"),
        *[F.min(F.when(F.col("tag") == f"SEARCH_{t}", F.struct("pos", "value"))).alias(t) for t in ("STATUS", "REASON", "FILTERED")],
    )
    is_product = F.col("product").isNotNull()
    top = F.max(F.when(is_product, F.struct("n", (-F.col("first")).alias("early"), "product")))
    g = light.groupBy(key).agg(top.alias("top"), F.coalesce(F.sum(F.when(is_product, F.col("n"))), F.lit(0)).alias("products"), F.sum("titled").alias("headings"), *[F.min(t)["value"].alias(t) for t in ("STATUS", "REASON", "FILTERED")])
    whole = _strip(F.coalesce(F.col(text), F.lit("")))
    nothing = whole.isin("", NOTHING) | whole.startswith(NOT_FOUND)
    asked = F.col(stated) if stated else F.lit(None).cast("string")
    out = texts.select(key, nothing.alias("__nothing"), asked.alias("__stated")).join(g, key, "left")
    n = F.coalesce("top.n", F.lit(0))
    return out.select(
        key,
        F.col("STATUS").alias("status"),
        F.col("REASON").alias("reason"),
        F.col("FILTERED").try_cast("long").alias("filtered"),
        (F.col("__nothing") | F.coalesce(F.col("STATUS") == NO_RESULT, F.lit(False))).alias("no_result"),
        F.coalesce("products", F.lit(0)).cast("long").alias("products"),
        F.coalesce("headings", F.lit(0)).cast("long").alias("headings"),
        F.col("top.product").alias("dominant_product"),
        n.cast("long").alias("dominant_count"),
        F.coalesce((n >= 2) & (F.col("__stated") != F.col("top.product")), F.lit(False)).alias("conflict"),
    )
