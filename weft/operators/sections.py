"""Markdown manuals to sections and catalog roll-ups, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import text as tx


#: A heading's line as it stands behind a line feed: as HEADING on the line alone, whose $ also stands before a last separator.
NEXT = r"\n(?=#{1,3}[ \t\x0B\f\r]+[^\n\r\x{85}\x{2028}\x{2029}]*[\r\x{85}\x{2028}\x{2029}]?(?:\n|\z))"
HEADING = r"^(#{1,3})\s+(.*)$"


def bodies(docs: DataFrame, product: str, text: str) -> DataFrame:
    """product, part, level and title (null before the first heading), raw: what stands under each heading; a text is parted in its own row."""
    whole = F.when(F.col(text).contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(F.col(text))
    parts = docs.select(F.col(product), F.posexplode(F.split(whole, NEXT)).alias("part", "body"))
    parts = parts.withColumn("line", F.when(F.col("body").startswith("#"), F.substring_index("body", "\n", 1)))
    parts = parts.withColumn("mark", F.regexp_extract("line", HEADING, 1))
    headed = F.col("mark") != ""
    raw = F.when(headed, F.substr("body", F.length("line") + 2)).otherwise(F.col("body"))
    return parts.select(product, "part", F.when(headed, F.length("mark")).alias("level"), F.when(headed, F.trim(F.regexp_extract("line", HEADING, 2))).alias("title"), F.trim(raw).alias("raw"))


def sections(docs: DataFrame, product: str = "product", text: str = "text") -> DataFrame:
    """product, section_id, heading, heading_path, text, pics, char_len, is_special, summary, tags: bodies between headings, empty ones left out."""
    rows = bodies(docs, product, text)
    # cleaned before they travel, once: the filter below stands behind the windows
    rows = rows.select(product, "part", "level", "title", body_text(F.col("raw")).alias("text"), tx.picture_names(F.col("raw")).alias("pics"))
    w = W.partitionBy(product).orderBy("part").rowsBetween(W.unboundedPreceding, 0)

    def current(level: int) -> Column:
        """The last heading of this level, unless a higher one came after it."""
        at = F.max(F.when(F.col("level") == level, F.struct("part", "title"))).over(w)
        if level == 1:
            return at["title"]
        above = F.max(F.when(F.col("level") < level, F.col("part"))).over(w)
        return F.when(above.isNull() | (at["part"] > above), at["title"])

    first = F.min(F.when(F.col("level") == 1, F.struct("part", "title"))).over(W.partitionBy(product))["title"]
    nth = F.sum(F.when(F.col("text") != "", 1).otherwise(0)).over(w).cast("int") - 1
    rows = rows.select(product, "part", "text", "pics", nth.alias("section_id"), current(1).alias("h1"), current(2).alias("h2"), current(3).alias("h3"), first.alias("doc_title")).filter("text <> ''")
    path = F.array_compact(F.array(F.when(~F.col("h1").eqNullSafe(F.col("doc_title")), F.col("h1")), F.col("h2"), F.col("h3")))
    rows = rows.withColumn("heading_path", path)
    rows = rows.withColumn("heading", F.when(F.size("heading_path") > 0, F.array_join("heading_path", " / ")).otherwise("(前言)"))
    return rows.select(
        product,
        "section_id",
        "heading",
        "heading_path",
        "text",
        "pics",
        F.length("text").alias("char_len"),
        tx.is_special(F.col("heading")).alias("is_special"),
        tx.summary(F.col("text")).alias("summary"),
        tx.section_tags(F.col("heading"), F.col("text")).alias("tags"),
    )


def body_text(raw: Column) -> Column:
    """Cleaned lines; runs of empty lines to one, picture lines right behind the text before them."""
    text = tx.replaced(tx.clean_markdown(tx.mark_pictures(raw)), ["\n\n\n"], r"\n{3,}", "\n\n")
    text = tx.replaced(text, ["<PIC>"], r"\n+(?=(?:<PIC> ?)+(?:\n|$))", "\n")
    return F.regexp_replace(text, r"^\n+|\n+$", "")


def heading_key(heading: Column) -> Column:
    return F.regexp_replace(F.lower(heading), r"[\s/>|:：\-]+", "")


def keep_section(text: Column, pics: Column, least: int = 12) -> Column:
    """Sections of a few characters stay only with pictures."""
    return (tx.units(text) >= least) | (F.size(pics) > 0)


def picture_check(sections_: DataFrame, docs: DataFrame, product: str = "product", text: str = "text") -> DataFrame:
    """product, in_sections, in_document, aligned."""
    a = sections_.groupBy(product).agg(F.sum(F.size("pics")).alias("in_sections"))
    b = docs.select(product, F.size(tx.picture_names(F.col(text))).alias("in_document"))
    return b.join(a, product, "left").select(product, F.coalesce("in_sections", F.lit(0)).alias("in_sections"), "in_document").withColumn("aligned", F.col("in_sections") == F.col("in_document"))


def catalog(sections_: DataFrame, product: str = "product") -> DataFrame:
    """A row for each product: totals and its sections in order."""
    one = F.struct("section_id", "heading", "summary", "char_len", "tags")
    g = sections_.groupBy(product).agg(F.count("*").alias("section_count"), F.sum("char_len").alias("total_chars"), F.sum(F.size("pics")).alias("total_pics"), F.array_sort(F.collect_list(one)).alias("sections"))
    return g


def size_stats(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """min, max, floor of the mean, and the upper median of a size."""
    median = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {size} DESC)")  # from above: of an even number the upper one
    return df.groupBy(*by).agg(F.min(size).alias("min"), F.max(size).alias("max"), F.floor(F.avg(size)).alias("avg"), median.cast(df.schema[size].dataType).alias("median"))


def searchable(product: Column, heading: Column, summary: Column, text: Column, caption: Column, aliases: Column | None = None) -> Column:
    """The parts of a chunk that hold something, by lines; aliases last."""
    parts = [F.nullif(c, F.lit("")) for c in (product, heading, summary, text, caption)]
    if aliases is not None:
        parts.append(F.nullif(F.array_join(aliases, "\n"), F.lit("")))
    return F.trim(F.concat_ws("\n", *parts))


def rerank_text(product: Column, heading: Column, caption: Column, summary: Column, text: Column, most: int = 900) -> Column:
    parts = [F.nullif(c, F.lit("")) for c in (product, heading, caption, summary, text)]
    return F.left(F.trim(F.concat_ws("\n", *parts)), F.lit(most))


def caption_text(chunks: DataFrame, captions: DataFrame, key: list[str]) -> DataFrame:
    """key, caption_aux: captions of a chunk's pictures in order; noise left out, tables by content only. captions: product, pic, category, short_caption, content."""
    pics = chunks.select(*key, "product", F.posexplode("pics").alias("pos", "pic"))
    rows = pics.join(captions, ["product", "pic"]).filter("category <> 'noise'")
    seg = F.when(F.col("category") == "info_table", F.trim("content")).otherwise(F.trim(F.concat_ws(" ", F.trim("short_caption"), F.trim("content"))))
    rows = rows.withColumn("seg", seg).filter("seg <> ''")
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seg"))), lambda x: x["seg"]), " ").alias("caption_aux"))


def with_parent(chunks: DataFrame, sections_: DataFrame, product: str = "product") -> DataFrame:
    """Chunks with their section's text; where the section is missing, their own."""
    s = sections_.select(product, F.col("section_id").alias("parent_section_id"), F.col("text").alias("__parent"))
    return chunks.join(s, [product, "parent_section_id"], "left").withColumn("result_text", F.coalesce("__parent", "text")).drop("__parent")


def readiness(components: dict[str, DataFrame]) -> DataFrame:
    """component, n, ready: rows of every component, in one query."""
    out = None
    for name, df in components.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("component"), "n", (F.col("n") > 0).alias("ready"))
        out = part if out is None else out.unionByName(part)
    return out
