"""Timed evidence: interval joins, scenes, frames and manifests. Times are seconds in doubles.

Interval joins are equi-joins on the record with the interval test as residual. A record with
very many rows (skew) takes the bucketed form: both sides get the bins of `width` seconds that
they touch, so a hot record is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOUCH = 0.001


def close(a: Column, b: Column, absolute: float = TOUCH, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def overlaps(left: DataFrame, right: DataFrame, record: str, start: str = "start", end: str = "end", width: float | None = None) -> DataFrame:
    """Pairs of rows of a record whose half-open intervals overlap; right's columns get the prefix r_."""
    right = right.select(F.col(record), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != record])
    hit = (F.col(start) < F.col(f"r_{end}")) & (F.col(end) > F.col(f"r_{start}"))
    if width is None:
        return left.join(right, record).filter(hit)
    # of the bins that a pair shares, the one of the later start reports it
    left = left.withColumn("__bin", _bins(F.col(start), F.col(end), width))
    right = right.withColumn("__bin", _bins(F.col(f"r_{start}"), F.col(f"r_{end}"), width))
    first = F.col("__bin") == F.floor(F.greatest(start, f"r_{start}") / width)
    return left.join(right, [record, "__bin"]).filter(hit & first).drop("__bin")


def points_inside(scenes: DataFrame, points: DataFrame, record: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Points in a scene's half-open interval or at its end: one at a shared border falls in both scenes."""
    return scenes.join(points, record).filter(((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))) | close(F.col(at), F.col(end)))


def containing_scene(scenes: DataFrame, points: DataFrame, record: str, point_id: str, order: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each point's one scene: the first that holds it, the last scene's end included; points in none are left out."""
    last = F.max(order).over(W.partitionBy(record))
    rows = scenes.withColumn("__last", F.col(order) == last).join(points, record)
    hit = ((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))) | (F.col("__last") & close(F.col(at), F.col(end)))
    first = F.row_number().over(W.partitionBy(record, point_id).orderBy(order))
    return rows.filter(hit).withColumn("__n", first).filter("__n = 1").drop("__n", "__last")


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def keyframe(start: Column, interval: Column, count: Column, folder: Column) -> Column:
    """Path of the keyframe at or before a scene's start."""
    n = F.least(F.floor(start / interval), count - 1)
    return F.concat(folder, F.lit("/frame_"), F.lpad(n.cast("string"), 6, "0"), F.lit(".jpg"))


def scene_bounds(cuts: Column, duration: Column, least: float) -> Column:
    """Bounds from sorted cuts: one is taken if it lies `least` after the last taken one and before the end."""
    taken = F.aggregate(
        F.array_sort(F.array_compact(cuts.cast("array<double>"))),
        F.array(F.lit(0.0)),
        lambda have, c: F.when((c - F.element_at(have, -1) >= least) & (duration - c >= least), F.concat(have, F.array(c))).otherwise(have),
    )
    return F.concat(taken, F.array(duration.cast("double")))


def scenes(df: DataFrame, record: str, cuts: Column, duration: Column, least: float) -> DataFrame:
    """record, scene (from 1), start, end."""
    b = df.select(record, scene_bounds(cuts, duration, least).alias("b"))
    pair = F.transform(F.slice("b", 1, F.size("b") - 1), lambda x, i: F.struct(x.alias("start"), F.get("b", i + 1).alias("end")))
    return b.select(record, F.posexplode(pair).alias("n", "x")).select(record, (F.col("n") + 1).alias("scene"), "x.start", "x.end")


def adjacent(df: DataFrame, by: str, bound: str) -> DataFrame:
    """Bounds to intervals: each with the next one."""
    return df.withColumn("end", F.lead(bound).over(W.partitionBy(by).orderBy(bound))).filter("end IS NOT NULL").withColumnRenamed(bound, "start")


def frame_groups(rows: DataFrame, record: str, at: str, frame: str, row_id: str, text: str, order: str) -> DataFrame:
    """Lines that were seen at once: a row for each record, time and frame, texts in order; a repeated id raises."""
    g = rows.groupBy(record, at, frame).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(row_id).alias("i"), F.col(text).alias("t")))).alias("x"), F.count("*").alias("n"), F.count_distinct(row_id).alias("d"))
    texts = F.when(F.col("n") == F.col("d"), F.transform("x", lambda v: v["t"])).otherwise(F.raise_error(F.lit("repeated observation id")).cast("array<string>"))
    return g.select(record, at, frame, texts.alias("texts"), F.transform("x", lambda v: v["i"]).alias("ids"))


def unique_text(rows: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """Texts of a group joined in order, white space folded, repeats (whatever their case) left out."""
    t = rows.select(*by, F.col(order).alias("o"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("t")).filter("t <> ''")
    first = t.groupBy(*by, F.lower("t").alias("key")).agg(F.min(F.struct("o", "t")).alias("x"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("text"))


def mean_confidence(log_probabilities: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean of min(1, exp(log probability)) and plain scores together, to 6 places; a group without any is left out."""
    a = log_probabilities.select(*by, F.least(F.lit(1.0), F.exp("value")).alias("c"))
    return a.unionByName(scores.select(*by, F.col("value").alias("c"))).groupBy(*by).agg(F.round(F.avg("c"), 6).alias("confidence"))


def mismatches(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with side `missing` or `extra`."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return e.join(f, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(f.join(e, key, "left_anti").withColumn("side", F.lit("extra")))


def to_process(sources: DataFrame, done: DataFrame, signature: list[str]) -> DataFrame:
    """Sources without a finished run of the same signature (null equals null)."""
    on = None
    d = done.select(*[F.col(c).alias(f"__{c}") for c in signature])
    for c in signature:
        eq = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = eq if on is None else on & eq
    return sources.join(d, on, "left_anti")


def reused(sources: DataFrame, done: DataFrame, signature: list[str]) -> DataFrame:
    return done.join(sources.select(*signature).distinct(), signature, "left_semi")


def expand_ids(df: DataFrame, key: str, ids: str, lookup: DataFrame, lookup_id: str, sep: str = "|") -> DataFrame:
    """Rows of a separated id list joined with a lookup, order kept in pos; unknown or repeated ids raise."""
    parts = F.when(F.col(ids) == "", F.array().cast("array<string>")).otherwise(F.split(ids, f"[{sep}]"))
    ok = F.when(F.size(F.array_distinct(parts)) == F.size(parts), parts).otherwise(F.raise_error(F.lit("repeated id")).cast("array<string>"))
    rows = df.select(key, F.posexplode(ok).alias("pos", lookup_id))
    rows = rows.join(lookup.withColumn("__known", F.lit(True)), lookup_id, "left")
    checked = F.when(F.col("__known"), F.col("pos")).otherwise(F.raise_error(F.lit("unknown id")).cast("int"))
    return rows.withColumn("pos", checked).drop("__known")


def evidence_rows(kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """record, kind_order, evidence_type, evidence_id, start, end, text of all kinds, one after another within a record."""
    out = None
    for n, (kind, df) in enumerate(kinds):
        part = df.select("record", F.lit(n).alias("kind_order"), F.lit(kind).alias("evidence_type"), F.col("evidence_id").cast("string"), F.col("start").cast("double"), F.col("end").cast("double"), "text")
        out = part if out is None else out.unionByName(part)
    return out


def normalised_interval(start: Column, end: Column, scene_start: Column, scene_end: Column, slack: float = 0.05) -> Column:
    """start, end (relative to the scene) and how they came about: absolute times are moved, a point becomes a second around it, what fits neither the whole scene."""
    length = scene_end - scene_start
    absolute = (scene_start - slack <= start) & (start < end) & (end <= scene_end + slack)
    s, e = F.when(absolute, start - scene_start).otherwise(start), F.when(absolute, end - scene_start).otherwise(end)
    point = (s >= 0) & (s <= length + slack) & (F.abs(e - s) <= slack)
    mid = F.least(length, F.greatest(F.lit(0.0), s))
    low, high = F.greatest(F.lit(0.0), mid - 0.5), F.least(length, mid + 0.5)
    s, e = F.when(point, F.when(high <= low, F.greatest(F.lit(0.0), length - 1.0)).otherwise(low)).otherwise(s), F.when(point, F.when(high <= low, length).otherwise(high)).otherwise(e)
    bad = (s < 0) | (e <= s) | (e > length + slack)
    basis = F.concat(F.when(absolute, "absolute_to_relative").otherwise("relative"), F.when(point, "|point_to_window").otherwise(""), F.when(bad, "|invalid_to_full_scene").otherwise(""))
    return F.struct(F.when(bad, F.lit(0.0)).otherwise(F.greatest(s, F.lit(0.0))).alias("start"), F.when(bad, length).otherwise(F.least(e, length)).alias("end"), basis.alias("basis"))


def raised_uncertainty(uncertainty: Column, basis: Column) -> Column:
    """An interval's uncertainty: high where the whole scene had to do, medium at least where a point was widened."""
    return F.when(F.contains(basis, F.lit("|invalid_to_full_scene")), "high").when(F.contains(basis, F.lit("|point_to_window")) & (uncertainty == "low"), "medium").otherwise(uncertainty)


def frame_offsets(duration: Column) -> Column:
    """Times of the frames to look at: one in scenes under 3 seconds, two under 8, else three; a little inside the scene."""
    inside = lambda share: F.least(F.greatest(duration * share, F.lit(0.05)), F.greatest(duration - 0.05, F.lit(0.05)))
    at = lambda *shares: F.array(*[inside(x) for x in shares])
    return F.when(duration <= 0, F.raise_error(F.lit("a scene without length")).cast("array<double>")).when(duration < 3, at(0.5)).when(duration < 8, at(0.2, 0.8)).otherwise(at(0.1, 0.5, 0.9))
