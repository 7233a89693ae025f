"""Exact Jaccard join of word shingles through a token-group matrix; components of its links.

A document's set holds the 64-bit hashes of its distinct word shingles (A-Z lower-cased, words
parted at ASCII white space; fewer words than the width make one shingle). Equal sets are one node.

Groups: nodes are sorted by their least hash, by size and by their least hash under another permutation, which
brings similar sets together; a group is a run of at most GROUP nodes that agree in the first and differ
in size by no more than the threshold allows. A row of the matrix says that a group's union holds a
token. Rows are needed only for tokens by which a link must show: in one order of all tokens,
rare ones first, two linked sets that need a tokens in common share SHARED (a if that is less) of the first
|s| - a + SHARED tokens of each (their prefixes), so the matrix holds the union of the members' prefixes.

Groups that share so many rows and whose sizes fit are candidates; what only happens to share a phrase isn't.
Candidates are opened only if they qualify: a member qualifies if its overlap with the other group's whole
union reaches what any link of it needs, and qualifying members are compared set by set, by
100 * common >= percent * union.

For the components not every link is needed: (1) links within groups, (2) each group with
LEADS groups that are drawn by most of its rows (a row draws LEADS of its groups by hashes of their ids), (3) groups with each other wherever a row's groups still lie in
different components. So a hot family of near copies costs rows in proportion to its groups, and
no link between different components is lost.

The order puts tokens of more than RARE documents behind the others, by the logarithm of their
count. Counts are exact but for tokens that share the bits counted by; any fixed order gives the
same links. Up to MAX_COMMON such tokens are broadcast; of more, the classes of the least counts
go with the rare ones, so that sets are never dealt token by token to be put in order. Tokens are
counted and prefixes cut where the texts lie; only prefixes meet the nodes.

Defined results: null and empty texts, and texts without a word, have an empty set and link with
nothing; a null id links with nothing, its component is null; rows with the same id are one node
and share a component; ties at the threshold are links. An empty table gives no row. Columns
n_shingles and component_id are the only ones returned besides the id. A percent under MIN_PERCENT
raises, for prefixes would hold most of a set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import chunks, map_arrow, materialize, mix64, temporary, texts_of
from weft.llm.linkage import components
from weft.llm.neardup import Shingler, common

GROUP = 32
#: Shingles of a group's members together, beyond the first member's.
GROUP_TOKENS = 200_000
RARE = 16
#: Rows that candidates share at least.
SHARED = 4
#: Groups that each group is compared with before all others: in a family of copies whose links are few, enough of them meet.
LEADS = 4
MIN_PERCENT = 50
#: Common tokens that are broadcast with their class (9 bytes each).
MAX_COMMON = 1_000_000
#: Node rows (24 bytes each) that may be broadcast to pick texts.
MAX_BROADCAST = 1_000_000
#: Tokens counted at once, in a task and in a range of hashes.
COUNTED = 2_000_000

_U = np.uint64
_SECOND = _U(0x9E3779B97F4A7C15)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Leading tokens of a set of n, SHARED of which any linked set has among its own."""
    needed = -(-n * percent // 100)
    return n - needed + np.minimum(needed, SHARED)


def sizes_fit(low, high, percent: int):
    return 100 * low >= percent * high


def overlap_needed(n: int, least: int, percent: int) -> int:
    """Tokens that a set of n shares at least with a linked set of `least` tokens or more."""
    m = max(n, least)
    return -(-percent * m // 100)


def marks(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n, f1 and f2 (a fingerprint of the set), k1 and k2 (its least hashes under two permutations)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in chunks(texts):
                sets = shingler.sets(texts[a:b])
                f = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype="<i8").reshape(-1, 2)
                least = np.array([[s[0], mix64(s * _SECOND).min()] if len(s) else [0, 0] for s in sets], dtype=_U).view(np.int64)
                cols = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in (*f.T, *least.T))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=["id", "n", "f1", "f2", "k1", "k2"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)), run, "id long, n long, f1 long, f2 long, k1 long, k2 long")


def grouped(nodes: DataFrame, percent: int) -> DataFrame:
    """id, gid (the group's first node): runs of similar nodes, in a sort that no key can crowd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = gid = None
        size = first = tokens = 0
        for batch in batches:
            out = []
            for i, n, k1 in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if k1 != key or size == GROUP or not sizes_fit(first, n, percent) or tokens + n > GROUP_TOKENS:
                    key, gid, size, first, tokens = k1, i, 0, n, 0
                size, tokens = size + 1, tokens + n
                out.append(gid)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "gid"])

    rows = nodes.select("id", "n", "k1", "k2")
    return map_arrow(rows.repartitionByRange("k1", "n", "k2", "id").sortWithinPartitions("k1", "n", "k2", "id"), run, "id long, gid long")


def with_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nodes with their texts."""
    wanted = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST else nodes
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id")


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, and whose they are."""
    if not sets:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches whose second column is a text, with the sets of their texts."""
    shingler = Shingler(width)
    for batch in batches:
        texts = texts_of(batch.column(1))
        for a, b in chunks(texts):
            yield batch.slice(a, b - a), shingler.sets(texts[a:b])


def common_tokens(rows: DataFrame, width: int, n_tokens: int) -> tuple[DataFrame, int]:
    """token (the bits counted by), class (bits of the count): tokens of more than RARE rows. rows: id, text; what copies add to a count changes the order alone."""
    bits = max(4, int(n_tokens // COUNTED).bit_length())  # a range of hashes for about COUNTED tokens
    low = _U(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit():
            keys, n = np.unique(np.concatenate(held) >> low, return_counts=True)
            part = (keys >> _U(32)).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                k, c = keys[a:b].astype("<u4"), n[a:b]
                again = c > 1
                cells = [k[~again].tobytes(), k[again].tobytes(), c[again].astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int64()), *(pa.array([x], pa.binary()) for x in cells)], names=["part", "once", "keys", "n"])

        for _, sets in set_batches(batches, width):
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield from emit()
                held, size = [], 0
        if size:
            yield from emit()

    def count(t: pa.Table) -> pa.Table:
        once, keys, n = (np.concatenate([np.frombuffer(x, "<u4") for x in t.column(c).to_pylist()]) for c in ("once", "keys", "n"))
        found, at = np.unique(np.concatenate([once, keys]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([np.ones(len(once)), n])).astype(np.int64)
        hot = total > RARE
        token = (_U(t.column("part")[0].as_py()) << _U(32)) | found[hot].astype(_U)
        return pa.table({"token": pa.array(token.view(np.int64)), "class": pa.array(np.ceil(np.log2(total[hot] + 1)).astype(np.int32))})

    counted = map_arrow(rows.select("id", "text"), run, "part long, once binary, keys binary, n binary")
    return counted.groupBy("part").applyInArrow(count, "token long, class int"), int(low)


def most_common(hot: DataFrame, limit: int) -> DataFrame:
    """The classes of the greatest counts that have no more than `limit` tokens together."""
    least = total = 0
    for kind, n in sorted(map(tuple, hot.groupBy("class").count().collect()), reverse=True):  # a row for each power of two
        total += n
        if total > limit:
            least = kind + 1
            break
    return hot.filter(F.col("class") >= least)


def prefixes(rows: DataFrame, hot: DataFrame, low: int, width: int, percent: int, max_common: int) -> DataFrame:
    """id, n, prefix (the leading tokens of the set, one after another), where there is a set. rows: id, text."""
    table = most_common(hot, max_common).toArrow()
    tokens = table.column("token").to_numpy().view(_U)
    order = np.argsort(tokens)
    sent = rows.sparkSession.sparkContext.broadcast((tokens[order], table.column("class").to_numpy().astype(np.int8)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes = sent.value
        for batch, sets in set_batches(batches, width):
            t, owner = flat(sets)
            weight = np.zeros(len(t), np.int8)
            if len(tokens):
                at = np.searchsorted(tokens, t >> _U(low))
                at[at == len(tokens)] = 0
                weight = np.where(tokens[at] == t >> _U(low), classes[at], 0)
            order = np.lexsort((t, weight, owner))
            n = np.array([len(s) for s in sets], np.int64)
            nth = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
            length = prefix_length(n, percent)
            first = t[order][nth < np.repeat(length, n)].astype("<u8")
            ends = np.concatenate([[0], np.cumsum(length * 8)]).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(first)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), cut], names=["id", "n", "prefix"])

    return map_arrow(rows.select("id", "text"), run, "id long, n int, prefix binary").filter("n > 0")


def matrix(cut: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, gid, lo and hi (sizes of members that have it in their prefixes). cut: as prefixes() makes it; nodes: id, gid."""
    wanted = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST else nodes.hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.zeros(0, "<i8"), *(np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist())]
            gid, n = (np.repeat(batch.column(c).to_numpy(), [*map(len, first[1:])]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(gid), pa.array(n)], names=["token", "gid", "n"])

    cells = map_arrow(cut.join(wanted, "id").select("gid", "n", "prefix"), run, "token long, gid long, n int")
    # one exchange by token: what is grouped by token and group, by token, and joined by token all lies so
    return cells.repartition("token").groupBy("token", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))


def opened(rows: DataFrame, width: int) -> DataFrame:
    """gid, ids, sets, union (of all members' tokens; empty for a group of one). rows: id, text, gid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in set_batches(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["id", "gid", "set"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            union = [b"" if len(s) == 1 else np.unique(np.concatenate(_arrays(s))).tobytes() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(union, pa.binary())], names=[*batch.schema.names, "union"])

    # a group has at most GROUP members
    groups = map_arrow(rows.select("id", "text", "gid"), run, "id long, gid long, set binary").groupBy("gid").agg(F.collect_list(F.struct("id", "set")).alias("m"))
    return map_arrow(groups.select("gid", F.col("m.id").alias("ids"), F.col("m.set").alias("sets")), unite, "gid long, ids array<long>, sets array<binary>, union binary")


def _arrays(sets: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(s, "<u8") for s in sets]


class Links:
    """Links found, less those that join what earlier ones have joined."""

    def __init__(self, percent: int):
        self.percent, self.out, self.parent = percent, [], {}

    def _root(self, i):
        while self.parent.get(i, i) != i:
            self.parent[i] = self.parent.get(self.parent[i], self.parent[i])
            i = self.parent[i]
        return i

    def compare(self, i, a: np.ndarray, j, b: np.ndarray) -> None:
        if not sizes_fit(min(len(a), len(b)), max(len(a), len(b)), self.percent):
            return
        x, y = self._root(i), self._root(j)
        if x != y:
            both = common(a, b)
            if 100 * both >= self.percent * (len(a) + len(b) - both):
                self.parent[max(x, y)] = min(x, y)
                self.out.append((i, j))


def _table(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def inner_links(groups: DataFrame, percent: int) -> DataFrame:
    """Links within groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = Links(percent)
            for ids, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets = _arrays(sets)
                for k in range(1, len(ids)):
                    for h in range(k):
                        links.compare(ids[h], sets[h], ids[k], sets[k])
            yield _table(links.out)

    return map_arrow(groups.filter(F.size("ids") > 1).select("ids", "sets"), run, "a long, b long")


def qualifying(sets: list[np.ndarray], union: np.ndarray, sizes: list[int], percent: int) -> list[int]:
    """Members that can be linked with a set of one of these sizes that lies within the union."""
    out = []
    for k, s in enumerate(sets):
        fitting = [m for m in sizes if sizes_fit(min(m, len(s)), max(m, len(s)), percent)]
        if fitting and common(s, union) >= overlap_needed(len(s), min(fitting), percent):
            out.append(k)
    return out


def outer_links(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links between the members of two groups; pairs: g, h (group ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = Links(percent)
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = _arrays(x["sets"]), _arrays(y["sets"])
                union = lambda z, sets: np.frombuffer(z["union"], "<u8") if len(sets) > 1 else sets[0]
                mine = qualifying(left, union(y, right), [*map(len, right)], percent)
                theirs = qualifying(right, union(x, left), [len(left[k]) for k in mine], percent) if mine else []
                for k in mine:
                    for h in theirs:
                        links.compare(x["ids"][k], left[k], y["ids"][h], right[h])
            yield _table(links.out)

    side = lambda s: groups.select(F.col("gid").alias(s), F.struct("ids", "sets", "union").alias(f"x{s}"))
    return map_arrow(pairs.join(side("h"), "h").join(side("g"), "g").select("xg", "xh"), run, "a long, b long")


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, max_common: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks of all rows, the node of each set, and the nodes' components: tables that are kept."""
    made = materialize(marks(docs, id_col, text_col, width), "marks", keep=True)
    known = made.filter("id IS NOT NULL AND n > 0")
    member = materialize(known.groupBy("f1", "f2").agg(F.min("id").alias("node")), "member", keep=True)
    nodes = known.join(member.withColumnRenamed("node", "id"), ["f1", "f2", "id"]).dropDuplicates(["f1", "f2"])
    nodes = materialize(grouped(nodes, percent), "groups")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot, low = common_tokens(rows, width, total)
    cells = matrix(prefixes(rows, materialize(hot, "common"), low, width, percent, max_common), nodes)
    # sizes are read on this side too, so that one exchange of the rows serves both sides of the join
    drawn = F.array(*[F.min(F.struct(F.xxhash64("gid", F.lit(r)), "gid"))["gid"] for r in range(LEADS)])
    leads = cells.groupBy("token").agg(F.min("gid").alias("lead"), F.max("gid").alias("other"), F.max("hi").alias("most"), F.array_distinct(drawn).alias("drawn")).filter("lead < other AND most > 0").select("token", "lead", "drawn")
    shared = materialize(cells.join(leads, "token"), "matrix")  # only tokens that two groups share
    rows_needed = lambda lo: F.least(F.lit(SHARED), F.floor((lo * percent + 99) / 100))

    def open_groups(gids: DataFrame) -> DataFrame:
        return materialize(opened(with_texts(docs, nodes.join(gids, "gid").select("id", "gid"), id_col, text_col), width), "opened", compression="none")

    several = nodes.groupBy("gid").agg(F.count("*").alias("k")).filter("k > 1").select("gid")
    each = shared.select("gid", "lo", F.explode("drawn").alias("to")).filter("gid <> to").groupBy("gid", "to").agg(F.count("*").alias("c"), F.min("lo").alias("lo")).filter(F.col("c") >= rows_needed(F.col("lo")))
    nth = F.row_number().over(W.partitionBy("gid").orderBy(F.desc("c"), "to"))  # a group has few rows, and LEADS draws of each
    first = each.withColumn("nth", nth).filter(F.col("nth") <= LEADS)
    first = materialize(first.select(F.least("gid", "to").alias("g"), F.greatest("gid", "to").alias("h")).distinct(), "first")
    groups = open_groups(first.select(F.explode(F.array("g", "h")).alias("gid")).union(several).distinct())
    links = materialize(inner_links(groups, percent).union(outer_links(first, groups, percent)), "links")
    comps = components(links)
    placed = nodes.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    spans = placed.groupBy("gid").agg(F.min("comp").alias("from"), F.max("comp").alias("to"))
    lead = spans.select(F.col("gid").alias("lead"), F.col("from").alias("lead_comp"))
    spread = materialize(shared.drop("drawn").join(spans, "gid").join(lead, "lead"), "spread")
    # a pair that still matters has a group that isn't wholly in the component of the row's least group
    strays = spread.filter("from <> to OR from <> lead_comp").select("token", *(F.col(c).alias(f"{c}2") for c in ("gid", "lo", "hi", "from", "to")))
    fits = f"gid <> gid2 AND 100 * hi >= {percent} * lo2 AND 100 * hi2 >= {percent} * lo AND NOT (from = to AND from2 = to2 AND from = from2)"
    met = spread.join(strays, "token").filter(fits).select(F.least("gid", "gid2").alias("g"), F.greatest("gid", "gid2").alias("h"), "token", F.least("lo", "lo2").alias("lo"))
    # a row comes twice where both of its groups are strays
    rest = met.groupBy("g", "h", "token").agg(F.min("lo").alias("lo")).groupBy("g", "h").agg(F.count("*").alias("c"), F.min("lo").alias("lo")).filter(F.col("c") >= rows_needed(F.col("lo"))).select("g", "h")
    rest = materialize(rest.join(first, ["g", "h"], "left_anti"), "rest")
    groups = open_groups(rest.select(F.explode(F.array("g", "h")).alias("gid")).distinct())
    more = materialize(outer_links(rest, groups, percent), "more")
    joined = links.union(more)
    twice = known.groupBy("id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).filter("lo < hi").select("id")
    if not twice.isEmpty():  # rows with the same id are one node, whatever their texts
        own = known.join(twice, "id").join(member, ["f1", "f2"]).select("id", "node").distinct()
        joined = joined.union(own.join(own.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b"))
    return made, member, materialize(components(joined), "components", keep=True)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, max_common: int = MAX_COMMON) -> DataFrame:
    """id, n_shingles, component_id: a row for each row of docs."""
    if not MIN_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {MIN_PERCENT} and 100")
    with temporary():
        made, member, joined = _linked(docs, id_col, text_col, width, percent, max_common)
    out = made.select("id", "n", "f1", "f2").join(member, ["f1", "f2"], "left")
    out = out.withColumn("node", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("node")).otherwise(F.col("id")))
    out = out.join(joined, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"))
