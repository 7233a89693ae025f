"""Prefix trie of conversations by partition refinement.

All conversations start in one class. Each round splits every active class by the next turn (role
and text): conversations that end leave it, those that go on alike form a class one deeper, which is
a node of the trie. A class with a single sequence left retires: the rest of its turns is a chain of
nodes with one child each, emitted at once. Conversations that are equal throughout count as one
sequence with a weight, so they retire together, and there are as many rounds as turns that two
different sequences share at most. Folding back goes the other way, from the deepest class to the
root, and adds children's leaves and savings to their parents; a chain's are suffix sums.

A node is known by its depth and its smallest conversation. Conversations of any length, and any
number of them that share turns or are equal, are dealt out by rows: turns are numbered in one
range sort with offsets per part, sums along a chain are taken in runs of RUN turns, splits
are aggregated before they shuffle, and joins on a class can be split. Turns are compared by
the SHA-256 of role and text, equal sequences by two 64-bit digests of these with their places, two
different ones of w sequences sharing both with odds of about w * w / 2**129. The digest of a node's
ends is one hash over all their numbers: these are sorted and joined in many tasks, in pieces of
PIECE bytes; only the pieces go through one task, a piece at a time.

Defined results: null roles and texts are empty; turns with the same number (null first) come in the
order of role and text; rows that repeat a turn are all kept; rows with a null conv_id take no part; a rebuilt
conversation without turns is a member of the root and ends there; an empty table has no node.
Other columns aren't carried over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import map_arrow, materialize, temporary

#: Turns of a chain that are summed in one window.
RUN = 4096
#: Bytes of the numbers of a node's ends that are joined to one piece.
PIECE = 1 << 16
#: A class of a round that may be broadcast to its members, in rows (some 60 bytes each); beyond it the join shuffles.
MAX_BROADCAST = 200_000


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest (of role and text), words (of the text): each conversation's turns in order."""
    body = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    words = F.when(F.trim(F.translate(body, "\t\n\x0b\f\r", "     ")) == "", 0).otherwise(F.size(F.split(F.trim(F.translate(body, "\t\n\x0b\f\r", "     ")), " +")))
    t = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), body.alias("text"))
    t = t.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    t = t.select("conv_id", digest.alias("digest"), words.cast("long").alias("words"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at = None, 0
        for batch in batches:
            nth = []
            for c in batch.column(0).to_pylist():
                conv, at = c, at + 1 if c == conv else 1
                nth.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=[*batch.schema.names, "nth"])

    t = materialize(map_arrow(t, run, "conv_id long, digest binary, words long, part int, nth long"), "turns")
    # a conversation lies in few parts, unless it is longer than a part
    sizes = t.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spread = sizes.withColumn("before", before).filter("before > 0").drop("n")
    return t.join(spread, ["conv_id", "part"], "left").select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns as numbered() makes them, and all conversations, after each takes its first h turns from conversation c - c % every; h = crc32(c) % most."""
    convs = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "convs")
    heads = materialize(turns.filter(F.col("pos") < most), "heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    wants = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    # a base has at most 2 * every - 1 conversations that draw on it
    got = wants.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("have")), "base", "left")
    got = got.withColumn("taken", F.least("h", F.coalesce("have", F.lit(0))))
    drawn = got.filter("taken > 0").join(heads.withColumnRenamed("conv_id", "base"), "base").filter("pos <= taken").select("conv_id", "pos", "digest", "words")
    own = turns.join(got.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return drawn.union(own), convs.select("conv_id")


def suffix_sums(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows (seq, pos, ..) with the sum of value over the turns of seq from pos on: within runs, and over runs."""
    r = rows.withColumn("run", F.floor(F.col("pos") / RUN))
    later = r.groupBy("seq", "run").agg(F.sum(value).alias("s"))
    back = F.coalesce(F.sum("s").over(W.partitionBy("seq").orderBy(F.desc("run")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    later = later.select("seq", "run", back.alias("behind"))
    here = F.sum(value).over(W.partitionBy("seq", "run").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn(out, here).join(later, ["seq", "run"]).withColumn(out, F.col(out) + F.col("behind")).drop("run", "behind")


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: of the numbers (column end) of each node's ends, ascending and joined by commas."""
    node = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, first, ",".join(held))], names=[*node.names, "first", "piece"])

        for batch in batches:
            for c, d, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (key != (c, d) or size >= PIECE):
                    yield piece()
                    held, size = [], 0
                if not held:
                    key, first = (c, d), end
                held.append(str(end))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            done = []
            for c, d, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key == (c, d):
                    state.update(b"," + text.encode())
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (c, d), hashlib.sha256(text.encode())
            yield rows(done)
        if key:
            yield rows([(*key, state.hexdigest())])

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=[*node.names, "ends_sha256"])

    e = ends.select("conv_id", "depth", "end").repartitionByRange("conv_id", "depth", "end").sortWithinPartitions("conv_id", "depth", "end")
    pieces = map_arrow(e, join, "conv_id long, depth long, first long, piece string")
    pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return map_arrow(pieces, digest, "conv_id long, depth long, ends_sha256 string")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def refined(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Members (conv_id, seq), a table of classes for each depth from 0 on, and the turns that go on in chains.

    turns: conv_id, pos, digest, words. A class: conv_id, parent, n_convs, words (of its last text), kept
    (its sequences, 1 if it has retired), ends (sequences that end there: 0 or 1, as equal ones are one).
    """
    place = lambda seed: F.xxhash64(F.lit(seed), "pos", "digest")
    whole = turns.groupBy("conv_id").agg(F.bit_xor(place(1)).alias("x"), F.bit_xor(place(2)).alias("y"), F.count("*").alias("len"))
    whole = convs.join(whole, "conv_id", "left").fillna(0, ["x", "y", "len"])
    whole = materialize(whole, "whole")
    first = whole.groupBy("x", "y", "len").agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight"))
    member = materialize(whole.join(first.drop("weight"), ["x", "y", "len"]).select("conv_id", "seq"), "member")
    seqs = materialize(first.select("seq", "weight", "len"), "sequences")
    steps = turns.withColumnRenamed("conv_id", "seq").join(seqs, "seq").repartitionByRange("pos", "seq")
    steps = materialize(steps.sortWithinPartitions("pos", "seq"), "steps")  # by place, so that a round reads little more than its turns
    root = seqs.agg(F.min("seq").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.sum("weight").alias("n_convs"), F.lit(0).cast("long").alias("words"), F.count("*").alias("kept"))
    levels, ended, retired = [materialize(root.filter("conv_id IS NOT NULL"), "level")], [], []
    top = levels[0].first()
    active, depth = seqs.withColumn("cls", F.lit(top["conv_id"] if top else None).cast("long")), 0
    if top and top["kept"] == 1:
        retired.append(seqs.select("seq", F.lit(0).alias("depth")))
        active = active.filter("false")
    while True:
        ended.append(active.filter(F.col("len") == depth).select(F.col("cls").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), "seq"))
        on = active.filter(F.col("len") > depth)
        if on.isEmpty():
            break
        depth += 1
        split = materialize(on.join(steps.filter(F.col("pos") == depth).select("seq", "digest", "words"), "seq"), "split")
        found = split.groupBy("cls", "digest").agg(F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("words").alias("words"), F.count("*").alias("kept"))
        found = materialize(found, "classes")
        levels.append(found.select("conv_id", F.col("cls").alias("parent"), "n_convs", "words", "kept"))
        moved = split.drop("words").join(_small(found.select("cls", "digest", "conv_id", "kept")), ["cls", "digest"])
        moved = materialize(moved.select("seq", "weight", "len", F.col("conv_id").alias("cls"), "kept"), "active")
        retired.append(moved.filter("kept = 1").select("seq", F.lit(depth).alias("depth")))
        active = moved.filter("kept > 1").drop("kept")
    alone = retired[0] if retired else active.select("seq", F.lit(0).alias("depth"))
    for r in retired[1:]:
        alone = alone.union(r)
    alone = materialize(alone, "alone")
    over = ended[0]
    for e in ended[1:]:
        over = over.union(e)
    # a retired sequence ends in its own chain, or in its class if no turn is left
    own = alone.join(seqs, "seq").select(F.col("seq").alias("conv_id"), F.col("len").cast("long").alias("depth"), "seq")
    ends = over.union(own).join(member.withColumnRenamed("conv_id", "end"), "seq").select("conv_id", "depth", "end")
    chains = steps.join(alone, "seq").filter(F.col("pos") > F.col("depth"))
    return ends, levels, chains


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node."""
    with temporary():
        return _trie(turns, convs)


def _trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    ends, levels, chains = refined(turns, convs)
    chains = chains.withColumn("own", (F.col("weight") - 1) * F.col("words"))
    chains = suffix_sums(chains, "own", "saved").select(
        F.col("seq").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.col("seq").alias("parent"),
        F.col("weight").alias("n_convs"),
        (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
    )
    chains = materialize(chains, "chains")
    folded, deeper = [], None
    for depth in range(len(levels) - 1, -1, -1):
        below = chains.filter(F.col("depth") == depth + 1).select("parent", "n_leaves", "saved_tokens")
        if deeper is not None:
            below = below.union(deeper.select("parent", "n_leaves", "saved_tokens"))
        below = below.groupBy("parent").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        # chain nodes below a class that has retired are its sequence's own
        level = levels[depth].join(below.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        zero = F.lit(0).cast("long")
        level = level.select(
            "conv_id",
            F.lit(depth).cast("long").alias("depth"),
            "parent",
            "n_convs",
            F.coalesce("c", zero).alias("n_children"),
            F.coalesce("l", F.lit(1).cast("long")).alias("n_leaves"),
            (F.coalesce("s", zero) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
        deeper = materialize(level, "folded", keep=True)
        folded.append(deeper)
    nodes = chains
    for level in folded:
        nodes = nodes.union(level)
    nodes = nodes.join(ends_digests(ends), ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    return materialize(out, "trie", keep=True)
