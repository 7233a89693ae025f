"""Overlong scenes into pieces of whole frames, with proof that the pieces make up the scene.

A scene's text is a head and a line for each frame. Where it is longer than a cap, the scene is archived
and replaced by pieces: its head, and runs of whole frames packed greedily under the cap. Before
that the frames given are rendered and held against the scene's text, so that pieces can only come from
what the text was made of: a frame that is missing, unknown, outside the scene's time or of another
record, and a text that was changed, raise, and so does an id that a piece would share with another row.

Packing is a fold in order. It reads only lengths: (scene, place, length) rows dealt by scene, sorted and
streamed through a task, so a scene with very many frames costs one task's time but not its memory;
texts are joined to the pieces afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a scene's text begins with where it has frames.
HEAD = "Frames:"


def frame_line(at: Column, text: Column) -> Column:
    """A frame as a line of a scene's text. Its time is rounded by its exact value, ties to even (format_string would round its shortest decimals, halves up)."""
    return F.concat(F.lit("["), F.call_function("format_number", at.cast("double"), F.lit("0.000")), F.lit("] "), text)


def packed(rows: DataFrame, key: str, order: str, length: str, cap: int, between: int = 1) -> DataFrame:
    """rows plus piece (from 1): each row goes to the open piece if it still fits under the cap, else opens one. A row beyond the cap is a piece of its own."""
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, used = None, 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column(kind.fieldNames().index(key)).to_pylist(), batch.column(kind.fieldNames().index(length)).to_pylist(), strict=True):
                if k != now:
                    now, piece, used = k, 1, n
                elif used + between + n <= cap:
                    used += between + n
                else:
                    piece, used = piece + 1, n
                out.append(piece)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "piece"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields) + ", piece int")


def _must(ok: Column, value: Column, problem: str, kind: str = "string") -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(problem)).cast(kind))


def proven(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """scene, record, at, frame, line, length and place (in order of time, then frame) of the scenes' frames; raises unless they make up the scenes' texts.

    scenes: scene, record, start, end, text; frames: frame, scene, record, at, text.
    """
    f = frames.select("frame", "scene", F.col("record").alias("of"), "at", frame_line(F.col("at"), F.col("text")).alias("line"))
    both = scenes.join(f, "scene", "full")
    inside = (F.col("of") == F.col("record")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    rows = both.select(
        "scene", "record", "start", "end", "text", "at", "frame",
        F.when(F.col("frame").isNull(), F.lit(None)).otherwise(_must(F.coalesce(inside, F.lit(False)), F.col("line"), "a frame lies outside its scene")).alias("line"),
    )
    n = W.partitionBy("scene").orderBy("at", "frame")
    rows = rows.withColumn("length", F.length("line")).withColumn("place", F.row_number().over(n)).withColumn("twice", F.lag("frame").over(W.partitionBy("scene").orderBy("frame")) == F.col("frame"))
    # a line's place in the text is known from the lengths before it: each line is compared where it must stand
    before = F.coalesce(F.sum("length").over(n.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.lit(len(HEAD)) + before + F.col("place")
    whole = F.lit(len(HEAD)) + F.sum("length").over(W.partitionBy("scene")) + F.count("line").over(W.partitionBy("scene"))
    fits = F.col("text").startswith(HEAD) & (F.substring("text", starts.cast("int"), F.col("length") + 1) == F.concat(F.lit("\n"), F.col("line"))) & (F.length("text") == whole)
    bare = F.col("line").isNull() & (F.col("text") == HEAD)
    rows = rows.withColumn("line", F.when(F.coalesce(bare, F.lit(False)), F.lit(None)).otherwise(_must(F.coalesce(fits & ~F.coalesce("twice", F.lit(False)), F.lit(False)), F.col("line"), "the frames don't make up the scene")))
    return rows.select("scene", "record", "at", "frame", "line", "length", "place")


def expanded(scenes: DataFrame, frames: DataFrame, cap: int) -> DataFrame:
    """id, parent, kind, record, start, end, piece, pieces, frames, text: scenes of at most cap characters as they are (kind `scene`), longer ones archived
    (kind `parent`) and followed by pieces (kind `piece`, id scene-0001, ..).

    An id that two rows would share raises when read. Scenes with a null id raise, as their frames can't be told.
    """
    s = scenes.select(_must(F.col("scene").isNotNull() & (F.col("scene") != ""), F.col("scene").cast("string"), "a scene without an id").alias("scene"), "record", "start", "end", "text")
    rows = proven(s, frames)
    long = s.filter(F.length("text") > cap)
    light = rows.filter("line IS NOT NULL").join(long.select("scene"), "scene", "left_semi")
    piece = packed(light.select("scene", "place", "length"), "scene", "place", "length", cap - len(HEAD) - 1).select("scene", "place", "piece")
    line = F.struct("place", "line", "frame")
    # a piece holds no more than the cap, or one frame
    g = light.select("scene", "place", "line", "frame").join(piece, ["scene", "place"]).groupBy("scene", "piece").agg(F.array_sort(F.collect_list(line)).alias("x"))
    g = g.withColumn("pieces", F.count("*").over(W.partitionBy("scene")))
    text = F.concat(F.lit(HEAD + "\n"), F.array_join(F.col("x.line"), "\n"))
    cut = g.join(long.select("scene", "record", "start", "end"), "scene").select(
        F.concat("scene", F.format_string("-%04d", "piece")).alias("id"), F.col("scene").alias("parent"), F.lit("piece").alias("kind"), "record", "start", "end", "piece", F.col("pieces").cast("int").alias("pieces"), F.size("x").alias("frames"), text.alias("text")
    )
    # every frame is read here, so that nothing goes out unproven
    counts = rows.groupBy("scene").agg(F.count("line").cast("int").alias("frames"))
    whole = s.join(counts, "scene").select(
        F.col("scene").alias("id"), F.lit(None).cast("string").alias("parent"), F.when(F.length("text") > cap, "parent").otherwise("scene").alias("kind"), "record", "start", "end", F.lit(None).cast("int").alias("piece"), F.lit(None).cast("int").alias("pieces"), "frames", "text"
    )
    out = whole.unionByName(cut)
    n = F.count("*").over(W.partitionBy("id"))
    return out.withColumn("__n", n).withColumn("id", _must(F.col("__n") == 1, F.col("id"), "an id is used twice")).drop("__n")
