"""Records of media pipelines: gates, lines of sampled frames, labelled captions, and the evidence manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators import timeline

#: Limits of media, and what each part of a caption is called.
MAX_SECONDS, MAX_PIXELS = 60.0, 3840 * 2160
LABELS = [("Visible product", "product_name"), ("Visible components", "visible_components"), ("Visible actions", "visible_actions"), ("Visible states", "visible_states"), ("Visible warnings", "safety_or_warning_text"), ("Visual uncertainty", "uncertainty")]
SAMPLED = (
    "OCR: Sampled-frame text; entries within a frame are simultaneous observations, not action order. Repeated text at later timestamps is retained. "
    "Numbered parts contain only part of the SAME frame, not successive actions. Frame sampling does not verify intervening actions, button counts, procedure completeness, or success."
)
MANIFEST = ["record", "kind_order", "evidence_type", "evidence_id", "start", "end", "text", "thumbnail", "confidence", "speech_ids", "frame_ids"]


def marked_as(column: str, value: str) -> Column:
    return F.col(column).eqNullSafe(F.lit(value))


def accepted(reviews: DataFrame) -> DataFrame:
    """Reviews accepted by three approvals, or by the one-reviewer protocol; a missing mark is no approval."""
    three = marked_as("license_review_status", "approved") & marked_as("content_review_status", "approved") & marked_as("adjudication_status", "approved")
    single = marked_as("review_protocol", "ai_single_reviewer_v1") & marked_as("reviewer_id", "R1") & marked_as("review_status", "completed") & marked_as("license_evidence_status", "verified")
    return reviews.filter((three | single) & marked_as("final_decision", "accept"))


def media_problem(seconds: Column, width: Column, height: Column, most_seconds: float = MAX_SECONDS, most_pixels: int = MAX_PIXELS) -> Column:
    """duration, resolution, or null if a medium is within its limits; a missing figure is outside."""
    long = F.coalesce((seconds <= 0) | (seconds > most_seconds), F.lit(True))
    large = F.coalesce((width <= 0) | (height <= 0) | (width.cast("long") * height > most_pixels), F.lit(True))
    return F.when(long, "duration").when(large, "resolution")


def recognised_lines(rows: DataFrame, texts: str, scores: str, polygons: str, least: float) -> DataFrame:
    """A row for each trimmed, non-empty line that scores `least` or more (a missing score is 0), with its polygon as JSON."""
    kept = [c for c in rows.columns if c not in (texts, scores, polygons)]
    lines = rows.select(*kept, scores, polygons, F.posexplode(texts).alias("line", "raw"))
    score = F.coalesce(F.get(scores, F.col("line")), F.lit(0.0))
    out = lines.select(*kept, "line", F.trim("raw").alias("text"), score.alias("score"), polygon_json(F.get(polygons, F.col("line"))).alias("polygon"))
    return out.filter((F.col("text") != "") & (F.col("score") >= least))


def polygon_json(points: Column) -> Column:
    """A list of points as compact JSON of doubles; null is an empty list."""
    return F.coalesce(F.to_json(F.transform(points, lambda p: F.transform(p, lambda x: x.cast("double")))), F.lit("[]"))


def words_json(words: Column) -> Column:
    """Timed words (structs start, end, word, probability) as compact JSON, rounded."""
    return F.to_json(F.transform(F.coalesce(words, F.array().cast("array<struct<start:double,end:double,word:string,probability:double>>")), lambda w: F.struct(F.bround(w["start"], 3).alias("start"), F.bround(w["end"], 3).alias("end"), w["word"].alias("word"), F.bround(w["probability"], 6).alias("probability"))))


def frame_time(name: Column, interval: Column, duration: Column) -> Column:
    """Time of a frame from the number at its name's end, at most the duration; a name without one raises."""
    n = F.regexp_extract(name, r"_([0-9]+)(?:\.[^.]*)?$", 1)
    return F.least(F.when(n != "", n.cast("double")).otherwise(F.raise_error(F.lit("a frame without a number")).cast("double")) * interval, duration)


def fresh(prior: Column, source: Column) -> Column:
    """Whether a finished run is as late as its source's (ISO texts with or without a zone, compared as times)."""
    return F.coalesce(F.to_timestamp(prior) >= F.to_timestamp(source), F.lit(False))


def caption_labels(caption: Column) -> Column:
    """A caption (struct of texts and lists of texts) as labelled lines; empty parts are left out."""
    said = lambda name: F.array_join(F.filter(F.transform(caption[name], lambda x: F.trim(x)), lambda x: x != ""), "; ")
    lines = [F.concat(F.lit("Visual summary: "), F.trim(caption["summary_en"])), F.concat(F.lit("视觉摘要: "), F.trim(caption["summary_zh"]))]
    lines += [F.when(said(name) != "", F.concat(F.lit(f"{label}: "), said(name))) for label, name in LABELS]
    return F.array_join(F.array(*lines), "\n")


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def sampled_lines(groups: DataFrame, by: list[str], at: str, frame: str, texts: str) -> DataFrame:
    """by and timeline: the header and a JSON line for each sampled frame, in order of time and frame."""
    at_text = F.when(F.col(at) == F.floor(F.col(at)), F.concat(F.floor(F.col(at)).cast("string"), F.lit(".0"))).otherwise(F.col(at).cast("string"))
    line = F.concat(F.lit('{"timestamp_seconds": '), at_text, F.lit(', "frame_id": '), quoted(F.col(frame)), F.lit(', "texts": ['), F.array_join(F.transform(texts, quoted), ", "), F.lit("]}"))
    rows = groups.select(*by, F.struct(F.col(at).alias("at"), F.col(frame).alias("frame"), line.alias("line")).alias("x"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit(SAMPLED + "\n"), listed).alias("timeline"))


def evidence_manifest(scenes: DataFrame, speech: DataFrame, frames: DataFrame, captions: DataFrame, media: DataFrame) -> DataFrame:
    """Rows of MANIFEST: every scene with what is said and read in it, then speech, then frame texts; within a record in order of kind and time.

    scenes: record, scene, start, end; speech: record, segment, start, end, text, log_probability; frames: record, observation,
    frame, at, text, confidence; captions: scene, text; media: record, interval, frames, folder. A scene without a caption raises
    when it is read, and so does speech or a frame text that lies in no scene.
    """
    folded = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    spoken = timeline.overlaps(scenes.select("record", "scene", "start", "end"), speech, "record")
    said = timeline.unique_text(spoken, ["scene"], "r_text", "r_order").withColumnRenamed("text", "said")
    seen = timeline.points_inside(scenes.select("record", "scene", "start", "end"), frames, "record")
    groups = timeline.frame_groups(seen, "scene", "at", "frame", "observation", "text", "observation")
    read = sampled_lines(groups, ["scene"], "at", "frame", "texts")
    sure = timeline.mean_confidence(spoken.select("scene", F.col("r_log_probability").alias("value")), seen.select("scene", F.col("confidence").alias("value")), ["scene"])
    ids = lambda rows, by, item, name: rows.groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, item))), lambda x: x[item].cast("string")), "|").alias(name))
    own = scenes.join(media, "record")
    for part in (said, read, sure, ids(spoken, "r_order", "r_segment", "speech_ids"), ids(seen, "at", "observation", "frame_ids"), captions.select("scene", F.col("text").alias("caption"), F.lit(True).alias("__has"))):
        own = own.join(part, "scene", "left")
    caption = F.when(F.col("__has"), F.trim("caption")).otherwise(F.raise_error(F.lit("a scene without a caption")))
    text = F.concat_ws("\n", F.concat(F.lit("ASR: "), F.nullif("said", F.lit(""))), F.col("timeline"), F.concat(F.lit("VLM: "), F.nullif(caption, F.lit(""))))
    thumbnail = timeline.keyframe(F.col("start"), F.col("interval"), F.col("frames"), F.col("folder"))
    empty = F.lit("")
    first = own.select("record", F.lit(0).alias("kind_order"), F.lit("video_scene").alias("evidence_type"), F.col("scene").cast("string").alias("evidence_id"), "start", "end", text.alias("text"), thumbnail.alias("thumbnail"), "confidence", F.coalesce("speech_ids", empty).alias("speech_ids"), F.coalesce("frame_ids", empty).alias("frame_ids"))

    def placed(rows: DataFrame, key: str, at: Column) -> DataFrame:
        points = rows.select("record", key, at.alias("at"))
        found = timeline.containing_scene(scenes.select("record", "scene", "start", "end"), points, "record", key, "start").select("record", key, F.lit(True).alias("__in"))
        out = rows.join(found, ["record", key], "left")
        return out.withColumn("text", F.when(F.col("__in"), F.col("text")).otherwise(F.raise_error(F.lit("evidence in no scene"))))

    s = placed(speech, "segment", timeline.midpoint(F.col("start"), F.col("end")))
    second = s.select("record", F.lit(1).alias("kind_order"), F.lit("speech_segment").alias("evidence_type"), F.col("segment").cast("string").alias("evidence_id"), "start", "end", "text", empty.alias("thumbnail"), F.round(F.least(F.lit(1.0), F.exp("log_probability")), 6).alias("confidence"), F.col("segment").cast("string").alias("speech_ids"), empty.alias("frame_ids"))
    f = placed(frames, "observation", F.col("at"))
    third = f.select("record", F.lit(2).alias("kind_order"), F.lit("frame_text").alias("evidence_type"), F.col("observation").cast("string").alias("evidence_id"), F.col("at").alias("start"), F.col("at").alias("end"), "text", F.col("frame").alias("thumbnail"), "confidence", empty.alias("speech_ids"), F.col("observation").cast("string").alias("frame_ids"))
    return first.unionByName(second).unionByName(third)


def picture_context(hits: DataFrame, picture: str, order: str, context: list[str]) -> DataFrame:
    """Each picture's product and heading as the last hit that shows it has them."""
    return hits.groupBy(picture).agg(F.max_by(F.struct(*context), order).alias("x")).select(picture, "x.*")


def with_summaries(sections: DataFrame, summaries: DataFrame, key: list[str], summary: str = "summary", error: str = "__ERROR__") -> DataFrame:
    """Sections with their summaries; one that tells of an error counts as missing."""
    return sections.join(summaries.filter(~F.startswith(F.coalesce(F.col(summary), F.lit(error)), F.lit(error))).select(*key, summary), key, "left")


def with_inventory(scenes: DataFrame, inventory: DataFrame, record: str) -> DataFrame:
    """Scenes with their record's inventory; a record without one raises when it is read."""
    rows = scenes.join(inventory.withColumn("__known", F.lit(True)), record, "left")
    kind = scenes.schema[record].dataType
    return rows.withColumn(record, F.when(F.col("__known"), F.col(record)).otherwise(F.raise_error(F.lit("a record without inventory")).cast(kind))).drop("__known")


def class_text(scenes: DataFrame, aliases: DataFrame, by: str, text: str) -> DataFrame:
    """Searchable text of scenes: the class, its aliases in order, the scene's own. aliases: by, place, alias."""
    said = aliases.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]), " ").alias("__a"))
    return scenes.join(said, by, "left").withColumn("searchable", F.concat_ws(" ", by, "__a", text)).drop("__a")


def tree_inputs(turns: DataFrame, shown: DataFrame, session: str, turn: str, recent: int) -> DataFrame:
    """Turns that a session's tree is built from: all but the most recent, and of these those that are offloaded or not shown.

    shown: session, turn, offloaded.
    """
    place = F.row_number().over(W.partitionBy(session).orderBy(F.desc(turn)))
    rows = turns.withColumn("__n", place).join(shown.select(session, turn, F.col("offloaded").alias("__off")), [session, turn], "left")
    return rows.filter((F.col("__n") > recent) | F.coalesce("__off", F.lit(True))).drop("__n", "__off")
