"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

Index: what one task reads of the documents is parted into shards of bounded size. In a shard the
documents are numbered by ascending length, so that a block holds documents of like length and its
greatest impact says something of them all, and a term's postings (document, occurrences) are stored in
blocks of BLOCK, document gaps and occurrences bit-packed at the block's own widths. Outside the
packed bytes each block has a head: its first and last document and the greatest impact in it, an
impact being what an occurrence count is worth in a document of that length, before the term's
weight. A list also keeps its KTH greatest impact.

Search: an item's pointers are moved over a shard a stretch at a time, a stretch reaching from one
block edge of any of its lists to the next. A shallow move reads heads only: the weighted maxima of
the blocks over a stretch bound every score in it. Lists of a single block are short and count by
their documents, as WAND's cursors do. Stretches below the item's k-th best score are passed over,
and blocks all of whose stretches are, stay packed. Others are unpacked, most promising first, and
their documents scored in full. Stretches that reach the threshold exactly are scored too, for ties go to the smaller
id. The threshold starts at the best of the KTH impacts of the item's terms, over all shards,
and rises with what a task has found in all its shards; the tasks' best are merged by item.

Scores are integers. N counts documents with a term, L all their terms, n a document's terms, df the
documents that hold a term: weight floor(1000 ln((2N+2)/(2df+1))), m = 100-90 + 90*n*N div L,
impact (10^9 tf) div (1000 tf + 8 m), score the sum of weight times impact over the item's terms.

Terms are known by 64-bit hashes (see words). Items are few against documents: their terms
restrict the index if they are at most MAX_TERMS, otherwise all terms are indexed; they go to the
tasks in blocks of at most ITEM_BYTES, each a pass over the shards.

Defined results: null and empty texts have no term and are found by nothing; rows with a null id
take no part, neither as document nor as item; rows that repeat a doc_id are documents of their own,
rows that repeat an item_id are one item with the terms of all; fewer than k rows come back where
fewer documents score above 0; empty tables give no row; other columns aren't carried over.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import chunks, discard, map_arrow, materialize, scratch_path, texts_of
from weft.llm.words import WordHasher

K = 10
#: Postings of a block; a list's last block may have fewer.
BLOCK = 128
#: Which of a list's greatest impacts is kept to start thresholds from; of use where k is no greater.
KTH = 10
#: A shard is closed at so many occurrences of terms, or documents.
SHARD_TERMS, SHARD_DOCS = 4_000_000, 200_000
#: Distinct terms of all items that may be broadcast to restrict the index (8 bytes each).
MAX_TERMS = 500_000
#: Bytes of items that go to the tasks at once.
ITEM_BYTES = 8 << 20
SHARDS = "ids binary, m binary, terms binary, df binary, kth binary, first binary, last binary, most binary, widths binary, data binary"
FOUND = "item_id long, doc_id long, score long"


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _slots(counts: np.ndarray) -> np.ndarray:
    """Places a block of so many postings is packed in: a power of two from 8 to BLOCK."""
    return np.maximum(8, 1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _grouped(*keys: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Rows by equal keys."""
    if len(keys[0]):
        found, of = np.unique(np.stack(keys), axis=1, return_inverse=True)
        for i, key in enumerate(found.T):
            yield tuple(key.tolist()), np.flatnonzero(of.reshape(-1) == i)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes."""
    bits = (values[:, :, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def unpack(data: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), -1, width)
    return bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


class Layout:
    """Where the blocks of a shard lie: from document counts and widths alone."""

    def __init__(self, df: np.ndarray, widths: np.ndarray | None = None):
        self.df = df
        self.blocks = -(-df // BLOCK)
        self.begin = np.cumsum(self.blocks) - self.blocks  # each list's first block
        self.list_of = np.repeat(np.arange(len(df)), self.blocks)
        nth = np.arange(len(self.list_of)) - self.begin[self.list_of]
        self.opens = nth == 0
        self.counts = np.minimum(BLOCK, df[self.list_of] - nth * BLOCK)
        self.at = np.cumsum(self.counts) - self.counts  # each block's first posting
        self.slots = _slots(self.counts)
        if widths is not None:
            self.locate(widths)

    def locate(self, widths: np.ndarray) -> None:
        self.widths = widths.reshape(-1, 2).astype(np.int64)
        self.sizes = self.slots[:, None] * self.widths // 8
        self.bytes_at = np.cumsum(self.sizes.sum(axis=1)) - self.sizes.sum(axis=1)


def encode(ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, owner: np.ndarray, n_docs: int, n_terms: int) -> list[bytes]:
    """A shard's columns. ids and lengths: a row a document; terms and owner (place of the document): a row an occurrence."""
    by_length = np.lexsort((ids, lengths))
    ids, m = ids[by_length], 10 + 90 * lengths[by_length] * n_docs // n_terms
    place = np.empty(len(by_length), np.int64)
    place[by_length] = np.arange(len(by_length))
    owner = place[owner]
    order = np.lexsort((owner, terms))
    terms, owner = terms[order], owner[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    tf, terms, doc = np.diff(np.append(start, len(terms))), terms[start], owner[start]
    words, df = np.unique(terms, return_counts=True)
    worth = impacts(tf, m[doc])
    lay = Layout(df)
    block = np.repeat(np.arange(len(lay.counts)), lay.counts)
    kth = np.zeros(len(df), np.int32)
    long = np.flatnonzero(df >= KTH)
    order = np.lexsort((-worth, np.repeat(np.arange(len(df)), df)))
    kth[long] = worth[order][(np.cumsum(df) - df)[long] + KTH - 1]
    before = np.empty(len(doc), np.int64)  # the document of the posting before, -1 at a list's start
    before[1:], before[0 : 1 if len(doc) else 0] = doc[:-1], -1
    before[lay.at[lay.opens]] = -1
    gaps, more = doc - before - 1, tf - 1
    if len(doc):
        most = np.maximum.reduceat(worth, lay.at)
        lay.locate(np.stack([_bits(np.maximum.reduceat(gaps, lay.at)), _bits(np.maximum.reduceat(more, lay.at))], axis=1))
    else:
        most = np.zeros(0, np.int64)
        lay.locate(np.zeros((0, 2), np.int64))
    data = np.zeros(int(lay.sizes.sum()), np.uint8)
    for which, values in enumerate((gaps, more)):
        for (slots, width), rows in _grouped(lay.slots, lay.widths[:, which]):
            if width:
                cells = lay.at[rows][:, None] + np.arange(slots)
                used = np.arange(slots) < lay.counts[rows][:, None]
                packed = pack(np.where(used, values[np.minimum(cells, len(values) - 1)], 0), width)
                data[(lay.bytes_at[rows] + which * lay.sizes[rows, 0])[:, None] + np.arange(packed.shape[1])] = packed
    first, last = doc[lay.at], doc[lay.at + lay.counts - 1]
    del block
    kinds = ("<i8", "<i8", "<u8", "<i4", "<i4", "<i4", "<i4", "<i4", "<u1", "<u1")
    return [np.ascontiguousarray(c).astype(k).tobytes() for c, k in zip((ids, m, words, df, kth, first, last, most, lay.widths.reshape(-1), data), kinds, strict=True)]


class Shard:
    """Reader of a shard: heads at once, postings only of blocks that are asked for."""

    def __init__(self, ids: bytes, m: bytes, terms: bytes, df: bytes, kth: bytes, first: bytes, last: bytes, most: bytes, widths: bytes, data: bytes):
        self.ids, self.m, self.terms = np.frombuffer(ids, "<i8"), np.frombuffer(m, "<i8"), np.frombuffer(terms, "<u8")
        self.first, self.last, self.most = (np.frombuffer(x, "<i4").astype(np.int64) for x in (first, last, most))
        self.lay = Layout(np.frombuffer(df, "<i4").astype(np.int64), np.frombuffer(widths, "<u1"))
        self.data = np.frombuffer(data, "<u1")
        total = int(self.lay.counts.sum())
        self.doc, self.worth = np.empty(total, np.int32), np.empty(total, np.int32)
        self.open = np.zeros(len(self.last), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        """Fill in the postings of blocks."""
        lay, blocks = self.lay, blocks[~self.open[blocks]]
        self.open[blocks] = True
        for (slots, wg, wt), rows in _grouped(lay.slots[blocks], *lay.widths[blocks].T):
            rows = blocks[rows]
            parts = []
            for which, width in enumerate((wg, wt)):
                if width:
                    at = lay.bytes_at[rows] + which * lay.sizes[rows, 0]
                    parts.append(unpack(self.data[at[:, None] + np.arange(slots * width // 8)], width))
                else:
                    parts.append(np.zeros((len(rows), slots), np.int64))
            base = np.where(lay.opens[rows], -1, self.last[rows - 1])
            used = np.arange(slots) < lay.counts[rows][:, None]
            doc = (base[:, None] + np.cumsum(parts[0] + 1, axis=1))[used]
            to = (lay.at[rows][:, None] + np.arange(slots))[used]
            self.doc[to], self.worth[to] = doc, impacts(parts[1][used] + 1, self.m[doc])

    def postings(self, blocks: np.ndarray) -> np.ndarray:
        """Places of all postings of blocks."""
        counts = self.lay.counts[blocks]
        return np.repeat(self.lay.at[blocks] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))

    def search(self, item: Item, k: int) -> None:
        """Offer the item every document of this shard that can still be among its k best."""
        at = np.searchsorted(self.terms, item.terms)
        at[at == len(self.terms)] = 0
        has = self.terms[at] == item.terms if len(self.terms) else np.zeros(len(at), bool)
        lists, weights = at[has], item.weights[has]
        weights, lists = weights[weights > 0], lists[weights > 0]
        if not len(lists):
            return
        lay = self.lay
        short = lay.blocks[lists] == 1
        self.unpack(lay.begin[lists[short]])
        cursors = [(w, slice(a, a + n)) for w, a, n in zip(weights[short].tolist(), lay.at[lay.begin[lists[short]]].tolist(), lay.df[lists[short]].tolist(), strict=True)]
        long = [(w, slice(b, b + n)) for w, b, n in zip(weights[~short].tolist(), lay.begin[lists[~short]].tolist(), lay.blocks[lists[~short]].tolist(), strict=True)]
        edges = [x for _, s in cursors for x in (self.doc[s], self.doc[s] - 1)] + [x for _, s in long for x in (self.last[s], self.first[s] - 1)]
        ends = np.unique(np.concatenate(edges))
        ends = ends[ends >= 0]  # stretch i: documents behind ends[i - 1], up to ends[i]
        bound = np.zeros(len(ends), np.int64)
        for w, s in cursors:
            bound[np.searchsorted(ends, self.doc[s])] += w * self.worth[s].astype(np.int64)
        over = []  # of each long list, the block over each stretch or -1
        for w, s in long:
            nth = np.searchsorted(self.last[s], ends)
            nth[nth == s.stop - s.start] = -1
            nth[self.first[s][nth] > ends] = -1
            bound += np.where(nth >= 0, w * self.most[s][nth], 0)
            over.append(nth)
        rank = np.argsort(-bound, kind="stable")
        done, size = 0, k
        while done < len(rank):
            some = rank[done : done + size]
            some = some[bound[some] >= item.threshold]
            if not len(some):
                break
            self._score(item, k, ends, np.sort(some), cursors, long, over)
            done, size = done + size, size * 4

    def _score(self, item, k, ends, some, cursors, long, over) -> None:
        live = np.zeros(len(ends), bool)
        live[some] = True
        total: dict[str, list] = {"doc": [], "part": []}
        for w, s in cursors:
            total["doc"].append(self.doc[s].astype(np.int64))
            total["part"].append(w * self.worth[s].astype(np.int64))
        for (w, s), nth in zip(long, over, strict=True):
            need = np.unique(nth[some])
            need = need[need >= 0] + s.start
            self.unpack(need)
            at = self.postings(need)
            total["doc"].append(self.doc[at].astype(np.int64))
            total["part"].append(w * self.worth[at].astype(np.int64))
        doc, part = np.concatenate(total["doc"]), np.concatenate(total["part"])
        keep = live[np.searchsorted(ends, doc)]
        score = np.zeros(len(self.ids), np.int64)
        np.add.at(score, doc[keep], part[keep])
        found = np.flatnonzero(score >= item.threshold)
        item.offer(score[found], self.ids[found], k)


@dataclass
class Item:
    """A query with its best documents so far; documents below the threshold can't be among the k best."""

    id: int
    terms: np.ndarray
    weights: np.ndarray
    threshold: int

    def __post_init__(self) -> None:
        self.score = self.doc = np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, doc: np.ndarray, k: int) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        top = np.lexsort((doc, -score))[:k]
        self.score, self.doc = score[top], doc[top]
        if len(top) == k:
            self.threshold = max(self.threshold, int(self.score[-1]))


@dataclass
class Index:
    """Shards in a table, with the counts that their impacts rest on."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_docs, n_terms = WordHasher(), 0, 0
        for batch in batches:
            _, n = words(texts_of(batch.column(0)))
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["d", "t"])

    got = map_arrow(docs.filter(F.col(id_col).isNotNull()).select(text_col), run, "d long, t long").agg(F.sum("d"), F.sum("t")).first()
    return got[0] or 0, got[1] or 0


def build_index(docs: DataFrame, only: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS, shard_docs: int = SHARD_DOCS) -> Index:
    """An index of all documents, of the terms in `only` (sorted hashes), or of all if it is None."""
    n_docs, n_terms = counts(docs, id_col, text_col)
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = WordHasher(), [], [0, 0]

        def close():
            ids, lengths, terms = (np.concatenate([h[i] for h in held]) for i in range(3))
            at = np.cumsum([0, *[len(h[0]) for h in held]])
            owner = np.concatenate([h[3] + a for h, a in zip(held, at, strict=False)])
            held.clear()
            size[:] = 0, 0
            cells = encode(ids, lengths, terms, owner, n_docs, n_terms)
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=[f.split()[0] for f in SHARDS.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), texts_of(batch.column(1))
            for a, b in chunks(texts):
                hashes, n = words(texts[a:b])
                full = n > 0
                owner = np.repeat(np.cumsum(full) - 1, n)
                if sent is not None:
                    at = np.searchsorted(sent.value, hashes)
                    at[at == len(sent.value)] = 0
                    hit = sent.value[at] == hashes if len(sent.value) else np.zeros(len(hashes), bool)
                    hashes, owner = hashes[hit], owner[hit]
                if full.any():
                    held.append((ids[a:b][full], n[full], hashes, owner))
                    size[0] += len(hashes)
                    size[1] += int(full.sum())
                if size[0] >= shard_terms or size[1] >= shard_docs:
                    yield close()
        if held:
            yield close()

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = materialize(map_arrow(rows, run, SHARDS), "shards", compression="none")
    if sent is not None:
        sent.unpersist()
    return Index(shards, n_docs, n_terms)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: a row for each distinct term of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        for batch in batches:
            hashes, n = words(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n), pa.int64()), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "item_id long, term long").distinct()


def term_counts(index: Index) -> DataFrame:
    """term, df, kth (the best of the shards' KTH impacts): from heads only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df, kth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(np.frombuffer(df, "<i4")), pa.array(np.frombuffer(kth, "<i4"))], names=["term", "df", "kth"])

    return map_arrow(index.shards.select("terms", "df", "kth"), run, "term long, df int, kth int").groupBy("term").agg(F.sum("df").alias("df"), F.max("kth").alias("kth"))


def weighted(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """item_id, t (its terms that documents hold, and their weights), least (a score that k documents reach, 1 at least)."""
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    rows = terms.join(term_counts(index), "term").withColumn("w", weight)
    least = F.greatest(F.max(F.col("w") * F.col("kth")), F.lit(1)) if k <= KTH else F.lit(1)
    return rows.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("t"), least.cast("long").alias("least"))


def _blocks(rows: DataFrame, limit: int) -> Iterator[list[Item]]:
    held, size = [], 0
    for item_id, t, least in rows.toLocalIterator():
        terms, weights = np.array([x[0] for x in t], np.int64).view(np.uint64), np.array([x[1] for x in t], np.int64)
        order = np.argsort(terms)
        held.append((item_id, terms[order], weights[order], least))
        size += terms.nbytes + weights.nbytes + sys.getsizeof(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: Index, terms: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item. terms as item_terms() makes them."""
    spark = index.shards.sparkSession
    out = scratch_path(spark, "ranked")
    spark.createDataFrame([], FOUND).write.parquet(out)
    for block in _blocks(weighted(terms, index, k), item_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = [Item(*x) for x in sent.value]
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Shard(*(c[i].as_py() for c in batch.columns))
                    for item in items:
                        shard.search(item, k)
            n = [len(x.doc) for x in items]
            if sum(n):
                columns = np.repeat([x.id for x in items], n), np.concatenate([x.doc for x in items]), np.concatenate([x.score for x in items])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

        map_arrow(index.shards, run, FOUND).write.mode("append").parquet(out)
        sent.unpersist()
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = spark.read.schema(FOUND).parquet(out)
    return found.select("item_id", F.row_number().over(best).alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K, max_terms: int = MAX_TERMS) -> DataFrame:
    """The k best documents of each item, through an index made for this call."""
    terms = materialize(item_terms(items), "terms")
    distinct = terms.select("term").distinct()
    only = None
    if distinct.count() <= max_terms:
        only = np.sort(np.array([r[0] for r in distinct.toLocalIterator()], np.int64).view(np.uint64))
    index = build_index(docs, only)
    out = search(index, terms, k)
    discard(index.shards, terms)
    return out
