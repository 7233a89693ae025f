"""Line dedup by a segment-partition edit join.

Lines are what line feeds part, less white space at their ends. A line of at least MIN_CHARS
characters is dropped if an earlier one (by document id, then by line) of at least that many is
within TAU edits of it, whether or not the earlier one is dropped itself; a shorter line of at
least EXACT_CHARS characters is dropped if an earlier one equals it; others stay.

Lines that are equal meet by a 128-bit hash, and all but the first go. The long ones are joined by
segments: a line of length l is split into TAU + 1 segments, of which two lines within TAU
edits share one, at a place that the lengths narrow down. Each distinct line sends its own
segments and, for each length up to TAU less than its own, the substrings that could equal a
segment there (the multi-match-aware selection), as 64-bit hashes of (length, segment number,
substring), all from prefix sums. Only hashes that two lines share go on: their lines' texts
are fetched, each compared with the earliest line of its hash, and lines that differ from that
one with all earlier lines of the hash, in blocks of bounded size on either side. The verification is a banded bit-parallel
edit distance on what common ends leave.

Defined results: a null text stays null and has no line; an empty text has one empty line; rows
with equal id and text are one document and get the same result; those with the same id only
are ordered by a hash of the text; null ids come first. Columns n_lines and n_dropped are
replaced, all others but the text are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import chunks, map_arrow, materialize, mix64, temporary, texts_of, without

TAU = 2
MIN_CHARS = 30
#: Shorter lines than MIN_CHARS go as exact repeats only, from this length on.
EXACT_CHARS = 3
#: Lines of a hash that are compared in one group.
BLOCK = 256
#: Bytes that may be broadcast; beyond it joins shuffle.
MAX_BROADCAST_BYTES = 64 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 20), base, dtype=_U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def lines_of(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n")]


def line_marks(lines: list[str]) -> np.ndarray:
    """Two signed 64-bit integers for each line."""
    data = b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines)
    return np.frombuffer(data, dtype="<i8").reshape(-1, 2)


def signatures(lines: list[str], tau: int = TAU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, line and whether it is a segment of the line itself, for all segments and selected substrings."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    up, down = powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(codes.astype(_U) + _U(1)) * up[: len(codes)], dtype=_U)])
    size = np.array([len(x) for x in lines], dtype=np.int64)
    start = np.cumsum(size) - size
    out, who, own = [], [], []
    for less in range(tau + 1):
        length = size - less  # of the lines probed for
        for i in range(tau + 1):
            short, extra = length // (tau + 1), length % (tau + 1)
            at = i * short + np.maximum(0, i - (tau + 1 - extra))
            span = short + (i >= tau + 1 - extra)
            low, high = max(-i, less - (tau - i)), min(i, less + (tau - i))
            for shift in range(low, high + 1):
                a = at + shift
                ok = np.flatnonzero((a >= 0) & (a + span <= size) & (span > 0))
                x, y = start[ok] + a[ok], start[ok] + a[ok] + span[ok]
                out.append(mix64(mix64((sums[y] - sums[x]) * down[x]) + length[ok].astype(_U) * _U(16) + _U(i)))
                who.append(ok)
                own.append(np.full(len(ok), less == 0 and shift == 0))
    return np.concatenate(out), np.concatenate(who), np.concatenate(own)


def within(a: str, b: str, k: int) -> bool:
    """Whether two lines are within k edits: common ends cut off, then Hyyro's banded bit vectors."""
    if abs(len(a) - len(b)) > k:
        return False
    if len(a) < len(b):
        a, b = b, a
    n = len(b)
    i, step = 0, 64
    while i < n and a[i : i + step] == b[i : i + step]:
        i += step
    i = min(i, n)
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j, n = 0, len(b)
    while j < n and a[len(a) - 1 - j] == b[n - 1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: n - j]
    if not b or len(a) <= k:
        return len(a) <= k
    return banded(a, b, k) <= k


def banded(a: str, b: str, k: int) -> int:
    """Edit distance of a and b (len(a) > k, lengths within k), or k + 1 if it is greater."""
    m, width = len(a), 2 * k + 1
    full, top = (1 << width) - 1, 1 << 2 * k
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << (i + k)  # bit i + k: row i + 1 stands at bit k of the first column's window
    vp, vn, dist = full << k & full, 0, k
    get, row = peq.get, top >> 1
    for j, c in enumerate(b):
        x = get(c, 0) >> j & full
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp) & full
        hn = d0 & vp
        if j < m - k:
            dist += not d0 & top
        else:
            dist += bool(hp & row) - bool(hn & row)
            row >>= 1
        if dist > 2 * k:
            return k + 1
        vp = (hn | ~((d0 & full) >> 1 | hp)) & full
        vn = (d0 & full) >> 1 & hp
    return dist if dist <= k else k + 1


def _small(df: DataFrame, size=24) -> DataFrame:
    """df to be broadcast if its bytes (a row's: size, a number or a column) are few enough."""
    return F.broadcast(df) if (df.agg(F.sum(F.lit(size) if isinstance(size, int) else size)).first()[0] or 0) <= MAX_BROADCAST_BYTES else df


def _places(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """l1, l2 (hash), d, f, line of every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes = batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                d, f, no, kept = [], [], [], []
                for i in range(a, b):
                    for n, x in enumerate(lines_of(texts[i])):
                        if len(x) >= min_chars:
                            d.append(ids[i])
                            f.append(hashes[i])
                            no.append(n)
                            kept.append(x)
                marks = line_marks(kept)
                yield pa.RecordBatch.from_arrays([pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(no, pa.int32())], names=["l1", "l2", "d", "f", "line"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)), run, "l1 long, l2 long, d long, f long, line int")


def _signed(docs: DataFrame, text_col: str, min_chars: int, tau: int) -> DataFrame:
    """sig, l1, own: the hashes of every line, repeats within a batch left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts, 1_000_000):
                own = list({x for t in texts[a:b] for x in lines_of(t) if len(x) >= min_chars})
                if own:
                    sig, who, seg = signatures(own, tau)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(line_marks(own)[:, 0][who]), pa.array(seg)], names=["sig", "l1", "own"])

    return map_arrow(docs.select(text_col), run, "sig long, l1 long, own boolean")


def _fetched(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """l1, l2, d, f, line, x: the lines' texts; wanted: l1, l2, d, f, line."""
    by_doc = wanted.groupBy("d", "f").agg(F.collect_list(F.struct("line", "l1", "l2")).alias("want"))
    by_doc = materialize(by_doc, "wanted")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("f"))
    rows = rows.join(_small(by_doc, 32 + 24 * F.size("want")), same).select("d", "f", "want", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("l1", "l2", "d", "f", "line", "x")}
            for d, f, want, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lines = lines_of(text or "")
                for w in want:
                    for k, v in (("l1", w["l1"]), ("l2", w["l2"]), ("d", d), ("f", f), ("line", w["line"]), ("x", lines[w["line"]])):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, {"x": pa.string(), "line": pa.int32()}.get(k, pa.int64())) for k, v in out.items()})

    return map_arrow(rows, run, "l1 long, l2 long, d long, f long, line int, x string").dropDuplicates(["l1", "l2"])


def _near(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, min_chars: int, tau: int) -> DataFrame:
    """l1, l2 of the distinct lines that an earlier, different line is within tau edits of."""
    signed = _signed(docs, text_col, min_chars, tau)
    shared = signed.groupBy("sig").agg(F.min("l1").alias("lo"), F.max("l1").alias("hi"), F.max("own").alias("any")).filter("lo < hi AND any").select("sig")
    shared = materialize(shared, "shared")
    crowd = materialize(signed.join(_small(shared), "sig").select("sig", "l1").distinct(), "crowd")
    places = firsts.join(crowd.select("l1").distinct(), "l1")
    known = materialize(_fetched(docs, places, id_col, text_col), "known")
    order = F.struct("d", "f", "line")
    rows = crowd.join(known.select("l1", "l2", order.alias("at")), "l1")
    lead = rows.groupBy("sig").agg(F.min(F.struct("at", "l1", "l2")).alias("lead"), F.count("*").alias("m")).filter("m > 1")
    rows = materialize(rows.join(lead, "sig").withColumn("first", F.col("at") == F.col("lead.at")), "rows")
    pairs = rows.filter("NOT first").select("l1", "l2", F.col("lead.l1").alias("p1"), F.col("lead.l2").alias("p2")).distinct()
    texts = known.select("l1", "l2", "x")
    pairs = pairs.join(texts, ["l1", "l2"]).join(texts.select(F.col("l1").alias("p1"), F.col("l2").alias("p2"), F.col("x").alias("y")), ["p1", "p2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([within(x, y, tau) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield batch.select(["l1", "l2"]).filter(keep)

    found = materialize(map_arrow(pairs.select("l1", "l2", "x", "y"), verify, "l1 long, l2 long").distinct(), "near")

    # Lines unlike their hash's first one, against all others before them: the open lines of a hash are
    # dealt to parts of some BLOCK lines, and so are all its lines; each pair of parts is a group.
    left = rows.filter("m > 2 AND NOT first").join(found.withColumn("gone", F.lit(True)), ["l1", "l2"], "left").withColumn("open", F.col("gone").isNull())
    sizes = materialize(left.groupBy("sig").agg(F.count("*").alias("all"), F.count_if("open").alias("opened")).filter("opened > 0"), "open")
    # where few hashes are left, their lines needn't meet by hash before they are dealt to blocks
    left = left.join(_small(sizes, 40), "sig")
    parts, open_parts = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("all", "opened"))
    part = lambda n: F.pmod(F.xxhash64("l1", "l2"), n).cast("int")
    asked = left.filter("open").select("sig", "l1", "l2", "at", F.lit(True).alias("asks"), part(open_parts).alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"))
    others = left.select("sig", "l1", "l2", "at", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), open_parts - 1)).alias("i"), part(parts).alias("j"))
    left = asked.union(others).join(texts, ["l1", "l2"])

    def search(t: pa.Table) -> pa.Table:
        rank = lambda p: (p["d"] is not None, p["d"] or 0, p["f"], p["line"])
        rows = [(rank(r["at"]), r) for r in t.to_pylist()]
        known = [(at, r["x"]) for at, r in rows if not r["asks"]]
        hits = [r for at, r in rows if r["asks"] and any(y < at and within(r["x"], x, tau) for y, x in known)]
        return pa.table({"l1": pa.array([r["l1"] for r in hits], pa.int64()), "l2": pa.array([r["l2"] for r in hits], pa.int64())})

    more = left.groupBy("sig", "i", "j").applyInArrow(search, "l1 long, l2 long")
    return found.union(more).distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, tau: int = TAU, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """d, f (id and text hash) and the numbers of the lines to drop, for each document that has any."""
    places = materialize(_places(docs, id_col, text_col, min(exact_chars, min_chars)), "places")
    firsts = places.groupBy("l1", "l2").agg(F.min(F.struct("d", "f", "line")).alias("p")).select("l1", "l2", "p.*")
    firsts = materialize(firsts, "firsts")
    near = materialize(_near(docs, firsts, id_col, text_col, min_chars, tau), "nearby")
    fate = firsts.select("l1", "l2", F.struct("d", "f", "line").alias("p")).join(near.withColumn("near", F.lit(True)), ["l1", "l2"], "left")
    gone = places.join(fate, ["l1", "l2"]).filter(F.col("near").isNotNull() | (F.col("p") != F.struct("d", "f", "line")))
    return gone.groupBy("d", "f").agg(F.collect_set("line").alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, tau: int = TAU, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """docs with the texts less their dropped lines, plus n_lines and n_dropped."""
    base = without(docs, "n_lines", "n_dropped")
    with temporary():
        drop = materialize(dropped_lines(docs, id_col, text_col, min_chars, tau, exact_chars), "drop", keep=True)
    drop = drop.toDF("__d", "__f", "__drop")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text_col) == F.col("__f"))
    rows = base.join(_small(drop, 32 + 4 * F.size("__drop")), same, "left").drop("__d", "__f")
    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at, n, names = base.columns.index(text_col), len(base.columns), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops, lines, gone = batch.column(at).to_pylist(), batch.column(n).to_pylist(), [], []
            for i, (text, drop) in enumerate(zip(texts, drops, strict=True)):
                lines.append(0 if text is None else text.count("\n") + 1)
                out = set(drop or ())
                if out:
                    texts[i] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in out)
                gone.append(len(out))
            cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=names)

    return map_arrow(rows, run, schema)
