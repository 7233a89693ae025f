"""Near-duplicate documents: HyperMinHash sketches, banding, estimate, exact check, components.

A document's set holds the hashes of its distinct word shingles (A-Z lower-cased, words parted
at ASCII white space; fewer words than the width make one shingle; none, an empty set). Equal
sets are collapsed to one node first, so exact copies cost nothing more.

Sketch: REGISTERS registers of 16 bits, each the least hash of a bucket kept as its count of
leading zeros (6 bits) and the MANTISSA bits behind its first one. Small sets (up to SMALL_MAX
shingles) use a hash function of its own for each register; larger ones (from LARGE_MIN) part
the shingles in 16 buckets and use 32 functions, an empty bucket borrowing from the next. Two
sets similar enough always share one of the two kinds. Bands of ROWS registers, each from
another function and bucket, are hashed to keys: at Jaccard 0.8 a band agrees with probability
0.17, so that all 64 disagree in fewer than 1 of 100,000 pairs.

Links: (1) each node of a key is compared with the key's least node, (2) within keys whose
nodes still lie in different components, with each other, in blocks of bounded size. A pair is
dropped if the estimate, corrected for registers that collide by chance, is MARGIN below the
threshold (only where both sets have SURE_MIN shingles or more, for the estimate to be that
sure); the others are decided on the full sets by 100 * common >= percent * union. Blocks send back only links
that join components, which loses none that matters for the components.

Defined results: null and empty texts have an empty set and link with nothing; a null id links
with nothing and is kept; rows with the same id are one node and share a component; exact ties
at the threshold are links. Columns n_shingles, component_id and kept are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import chunks, map_arrow, materialize, mix64, temporary, texts_of
from weft.llm.linkage import components

REGISTERS, ROWS, BUCKETS, FUNCTIONS = 512, 8, 16, 32
BANDS = REGISTERS // ROWS
MANTISSA = 10
SMALL_MAX, LARGE_MIN = 96, 72
MARGIN = 0.15
SURE_MIN = 200
#: Least threshold in percent that SMALL_MAX, LARGE_MIN and the bands fit.
MIN_PERCENT = 80
#: Nodes of a key compared at once; larger keys are split into pairs of such blocks.
BLOCK = 1024
#: Node ids (8 bytes each) that may be broadcast to pick candidates' texts; beyond it the join shuffles.
MAX_BROADCAST = 2_000_000

_U = np.uint64
_rng = np.random.Generator(np.random.Philox(key=977))
_BASE = _U(_rng.integers(0, 2**63) * 2 + 1)
_BYTES = _rng.integers(1, 2**63, 256).astype(_U)
_WORDS = (_rng.integers(0, 2**62, 16) * 2 + 1).astype(_U)
_ODD = (_rng.integers(0, 2**62, REGISTERS) * 2 + 1).astype(_U)
_BANDS_AT = np.array([[(8 * g + i) * BUCKETS + (b * int(o) + int(s)) % BUCKETS for i, (o, s) in enumerate(zip(_rng.integers(0, 8, ROWS) * 2 + 1, _rng.integers(0, 16, ROWS), strict=True))] for g in range(FUNCTIONS // ROWS) for b in range(BUCKETS)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sorted arrays of distinct shingle hashes, without a Python object for each word."""

    def __init__(self, width: int):
        if not 1 <= width <= len(_WORDS):
            raise ValueError("width")
        self.width, self.up, self.down = width, _powers(_BASE, 1), _powers(_BASE, 1)

    def _tables(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 18)
            self.up, self.down = _powers(_BASE, n), _powers(_U(pow(int(_BASE), -1, 2**64)), n)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a, b in chunks(texts, 400_000):
            out += self._sets([t.encode("utf-8", "surrogatepass") for t in texts[a:b]])
        return out

    def _sets(self, raw: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        self._tables(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[_LOWER[data]] * self.up[: len(data)], dtype=_U)])
        word = mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(_U))
        sizes = np.cumsum([len(r) + 1 for r in raw]) + 1
        last = np.searchsorted(starts, sizes[:-1]) if len(raw) > 1 else np.zeros(0, np.int64)
        first, last = np.concatenate([[0], last]), np.concatenate([last, [len(starts)]])
        n, w = len(word), self.width
        if n >= w:
            rolled = sum((word[i : n - w + 1 + i] * _WORDS[i] for i in range(1, w)), word[: n - w + 1] * _WORDS[0])
            rolled = mix64(rolled)
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= w:
                out.append(np.unique(rolled[a : b - w + 1]))
            elif b > a:
                out.append(mix64(np.array([(word[a:b] * _WORDS[: b - a]).sum(dtype=_U) + _U(b - a)])))
            else:
                out.append(np.zeros(0, _U))
        return out


def registers(least: np.ndarray) -> np.ndarray:
    """16 bits for each 64-bit minimum: its leading zeros, then the bits behind the first one."""
    m, e = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - e, 0, 63)
    return (zeros.astype(np.uint16) << MANTISSA) | ((m * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def _hashed(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    v = s[None, :] * odd[:, None]
    v ^= v >> _U(32)
    v *= _U(0x9E3779B97F4A7C15)
    return v


def sketch_small(s: np.ndarray) -> np.ndarray:
    return registers(_hashed(s, _ODD).min(axis=1))


def sketch_large(s: np.ndarray) -> np.ndarray:
    """s is sorted, so buckets (the highest 4 bits) are runs."""
    at = np.searchsorted(s, np.arange(BUCKETS, dtype=_U) << _U(60))
    filled = np.flatnonzero(np.diff(np.append(at, len(s))))
    source = filled[np.searchsorted(filled, np.arange(BUCKETS)) % len(filled)]
    place = np.searchsorted(filled, source)
    step = max(1, 1_000_000 // len(s))
    least = np.concatenate([np.minimum.reduceat(_hashed(s, _ODD[t : min(t + step, FUNCTIONS)]), at[filled], axis=1) for t in range(0, FUNCTIONS, step)])
    return registers(least[:, place].reshape(-1))


def band_keys(sketch: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    picked = sketch[:, _BANDS_AT].astype(_U)
    packed = (picked[..., 0] << _U(48)) | (picked[..., 1] << _U(32)) | (picked[..., 2] << _U(16)) | picked[..., 3]
    other = (picked[..., 4] << _U(48)) | (picked[..., 5] << _U(32)) | (picked[..., 6] << _U(16)) | picked[..., 7]
    salt = mix64(np.arange(BANDS, dtype=_U) + _U(1 + 1000 * kind))
    return mix64(mix64(packed + salt) ^ (other * _U(0xD6E8FEB86659FD93)))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard from agreeing registers, less the share expected to collide by chance."""
    ratio = na / nb
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def kinds(n: int) -> list[int]:
    return [k for k, use in ((0, 0 < n <= SMALL_MAX), (1, n >= LARGE_MIN)) if use]


def sketch(s: np.ndarray) -> bytes:
    """Registers of each kind that a set of this size has; nothing for an empty set."""
    return b"".join((sketch_large if k else sketch_small)(s).astype("<u2").tobytes() for k in kinds(len(s)))


def of_kind(data: bytes, n: int, kind: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2").reshape(-1, REGISTERS)[kinds(n).index(kind)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in both of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Node:
    __slots__ = ("id", "comp", "n", "sketch", "set")

    def __init__(self, id, comp, n, sketch, data):
        self.id, self.comp, self.n, self.sketch, self.set = id, comp, n, sketch, np.frombuffer(data, dtype="<u8")


def promising(x: Node, y: Node, percent: int) -> bool:
    """False if sizes or the estimate rule a link out."""
    low, high = min(x.n, y.n), max(x.n, y.n)
    if 100 * low < percent * high:
        return False
    if low < SURE_MIN:
        return True
    a, b = of_kind(x.sketch, x.n, 1), of_kind(y.sketch, y.n, 1)
    return float(estimate(a, b, low, high)) >= percent / 100 - MARGIN


def linked(x: Node, y: Node, percent: int) -> bool:
    if not promising(x, y, percent):
        return False
    both = common(x.set, y.set)
    return 100 * both >= percent * (x.n + y.n - both)


def block_links(left: list[Node], right: list[Node] | None, percent: int) -> list[tuple[int, int]]:
    """Links between different components, of left with right, or within left if right is None; those only that join what is still apart."""
    nodes = left + (right or [])
    parent: dict[int, int] = {}

    def root(c):
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    out = []
    sizes = np.array([x.n for x in nodes])
    comp = np.array([x.comp for x in nodes])
    flat = np.concatenate([x.set for x in nodes])
    owner = np.repeat(np.arange(len(nodes)), sizes)
    values, column = np.unique(flat, return_inverse=True)
    counts = np.bincount(column)
    shared = counts[column] > 1  # a shingle of one node only adds to no pair
    column, owner = np.cumsum(counts > 1)[column[shared]] - 1, owner[shared]
    width = int((counts > 1).sum())
    n_left = len(left) if right is not None else len(nodes)
    both = np.zeros((n_left, len(nodes)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = max(256, 8_000_000 // max(1, len(nodes)))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        m = np.zeros((len(nodes), min(step, width - a)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        both += m[:n_left] @ m.T
    union = sizes[:n_left, None] + sizes[None, :] - both
    hit = (100.0 * both >= percent * union) & (comp[:n_left, None] != comp[None, :])
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = nodes[i], nodes[j]
        if right is not None and j < n_left:
            continue
        if (r := root(x.comp)) != (s := root(y.comp)):
            parent[max(r, s)] = min(r, s)
            out.append((x.id, y.id))
    return out


def group_links(nodes: list[Node], percent: int) -> list[tuple[int, int]]:
    """Links within a small group, pair by pair, or by matrix in a larger one."""
    if len(nodes) > 24:
        return block_links(nodes, None, percent)
    return [(x.id, y.id) for i, x in enumerate(nodes) for y in nodes[i + 1 :] if x.comp != y.comp and linked(x, y, percent)]


SKETCHES = "id long, n long, f1 long, f2 long, sketch binary"


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n, f1 and f2 (a fingerprint of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts):
                sets = shingler.sets(texts[a:b])
                marks = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([sketch(s) for s in sets], pa.binary())], names=["id", "n", "f1", "f2", "sketch"]
                )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)), run, SKETCHES)


def bands(nodes: DataFrame) -> DataFrame:
    """key, id: a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, data = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for at in range(0, len(ids), 256):
                for kind in (0, 1):
                    rows = [i for i in range(at, min(at + 256, len(ids))) if kind in kinds(sizes[i])]
                    if rows:
                        keys = band_keys(np.stack([of_kind(data[i].as_py(), sizes[i], kind) for i in rows]), kind)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), pa.array(np.repeat(ids[rows], BANDS), pa.int64())], names=["key", "id"])

    return map_arrow(nodes.select("id", "n", "sketch"), run, "key long, id long")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n, sketch, set of the documents in ids."""
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts):
                sets = shingler.sets(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["id", "n", "sketch", "set"]
                )

    return map_arrow(rows, run, "id long, n long, sketch binary, set binary")


def pair_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    side = lambda s: sets.select(F.col("id").alias(s), F.struct("n", "sketch", "set").alias(f"x{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            xs, ys = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(a)):
                x, y = xs[i].as_py(), ys[i].as_py()
                keep.append(linked(Node(0, 0, x["n"], x["sketch"], x["set"]), Node(1, 1, y["n"], y["sketch"], y["set"]), percent))
            keep = np.array(keep, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "xa", "xb")
    return map_arrow(both, run, "a long, b long")


def rest_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within keys; rows: key, id, comp, m (nodes of the key).

    A key of over BLOCK nodes is split into blocks, and each pair of blocks is a group.
    """
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    rows = rows.select("key", "id", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = rows.select("key", "id", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        nodes = [Node(*r) for r in zip(*(t.column(c).to_pylist() for c in ("id", "comp", "n", "sketch", "set")), strict=True)]
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("own").to_pylist()
        if i == j:
            found = group_links(nodes, percent)
        else:
            left, right = [x for x, o in zip(nodes, own, strict=True) if o == i], [x for x, o in zip(nodes, own, strict=True) if o == j]
            found = block_links(left, right, percent) if left and right else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.join(sets, "id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept: a row for each row of docs. A percent under MIN_PERCENT raises."""
    if not MIN_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {MIN_PERCENT} and 100")
    with temporary():
        made, member, joined = _joined(docs, id_col, text_col, width, percent)
    out = made.select("id", "n", "f1", "f2").join(member, ["f1", "f2"], "left")
    out = out.withColumn("node", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("node")).otherwise(F.col("id")))
    out = out.join(joined, "node", "left").withColumn("component_id", F.coalesce("comp", "node"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, the node of each set, and the nodes' components: tables that are kept."""
    made = materialize(sketches(docs, id_col, text_col, width), "sketches", keep=True, compression="none")
    known = made.filter("id IS NOT NULL AND n > 0")
    # a table of its own, so that the joins with it read plain exchanges and a hot group of copies can be split
    member = materialize(known.groupBy("f1", "f2").agg(F.min("id").alias("node")), "member", keep=True)
    # one row a node: an id that repeats with other texts stays one node for each of them in the bands
    nodes = known.join(member.withColumnRenamed("node", "id"), ["f1", "f2", "id"]).dropDuplicates(["f1", "f2"])
    nodes = materialize(nodes.select("id", "n", "sketch"), "nodes", compression="none")
    keyed = bands(nodes)
    leaders = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m")).filter("m > 1")
    crowded = materialize(keyed.join(leaders, "key"), "crowded")  # only keys that two nodes share
    pairs = materialize(crowded.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = materialize(full_sets(docs, ids, id_col, text_col, width), "sets", compression="none")
    links = materialize(pair_links(pairs, sets, percent), "found")
    comps = components(links)
    placed = crowded.select("key", "id", "m").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    more = materialize(rest_links(placed.join(apart, "key"), sets, percent), "more")
    joined = links.union(more).union(comps.select("node", "comp"))
    # rows with the same id are one node, whatever their texts: where an id has several sets, their nodes are linked
    twice = known.groupBy("id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).filter("lo < hi").select("id")
    if not twice.isEmpty():
        own = known.join(twice, "id").join(member, ["f1", "f2"]).select("id", "node").distinct()
        joined = joined.union(own.join(own.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b"))
    return made, member, materialize(components(joined), "components", keep=True)
