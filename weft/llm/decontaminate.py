"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space is folded to single blanks. An item of m
characters may differ by k = m * RATE edits, rounded down. It is split into k + 1 even pieces
(of 6 to 10 characters at a RATE of 0.1), so any passage within k edits holds one piece unchanged.
An Aho-Corasick automaton of all pieces finds these in every whole text. Around each hit the
groups of 2, 4, 8, .. neighbouring pieces that the piece is in are searched for, then the whole
item, with Myers' bit-parallel distance. Of g pieces at most g - 1 edits are allowed: if a group
is within that, so is one of its halves, down to a piece without edits, so no passage is lost.

Items go to the tasks in blocks of at most BLOCK_CHARS characters.

Items of fewer than SHORT characters match exactly: a text that equals them, or with in_words also
a run of whole words of it (no letter or digit before and behind).

Defined results: null and empty items match nothing, null and empty texts hold nothing; items with the same id or
text are separate, each row reported once per (document row, item row); an empty table on
either side gives no row. Items with a null id are reported with that null.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weft.llm.common import map_arrow, texts_of, without

RATE = 0.1
SHORT = 20
BLOCK_CHARS = 500_000


def folded(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return max(0, min(int(len(item) * rate), len(item) - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their offsets, lengths even but for one."""
    n, cuts = len(item), [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b <= n]


def groups(item: str, k: int) -> list[list[tuple[int, int, int, str]]]:
    """For each piece the groups it is in, less the whole item: characters before and behind the piece's start, edits, text."""
    cuts, out = [len(item) * i // (k + 1) for i in range(k + 2)], []
    for i in range(k + 1):
        own, g = [], 2
        while g <= k:
            a, b = i // g * g, min(i // g * g + g, k + 1)
            if b - a > g // 2:  # else it is the group before
                own.append((cuts[i] - cuts[a], cuts[b] - cuts[i], b - a - 1, item[cuts[a] : cuts[b]]))
            g *= 2
        out.append(own)
    return out


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def nearest(peq: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of the pattern from any part of the text (Myers' bit vectors)."""
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    """Pieces of a block of items, ready to search texts."""

    def __init__(self, items: list[str], rate: float = RATE, in_words: bool = False):
        self.items = [folded(t) for t in items]
        self.k = [budget(t, rate) for t in self.items]
        self.short: dict[str, list[int]] = {}
        self.peq: dict[str, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int, list]]] = {}
        for n, (t, k) in enumerate(zip(self.items, self.k, strict=True)):
            if 0 < len(t) < SHORT:
                self.short.setdefault(t, []).append(n)
            elif t:
                for (at, piece), above in zip(pieces(t, k), groups(t, k), strict=True):
                    found.setdefault(piece, []).append((n, at, above))
        self.words = ahocorasick.Automaton()
        for t, places in self.short.items() if in_words else ():
            self.words.add_word(t, (len(t), places))
        if len(self.words):
            self.words.make_automaton()
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def nearest(self, pattern: str, text: str) -> int:
        peq = self.peq.get(pattern)
        if peq is None:
            peq = self.peq[pattern] = masks(pattern)
        return nearest(peq, len(pattern), text)

    def search(self, text: str) -> list[tuple[int, int]]:
        """(item, distance) of each item that some part of the text matches."""
        text = folded(text)
        out = [(n, 0) for n in self.short.get(text, ())]
        if len(self.words):
            held: set[int] = set()
            for end, (size, places) in self.words.iter(text):
                start = end + 1 - size
                joined = start and text[start - 1].isalnum() and text[start].isalnum() or text[end + 1 : end + 2].isalnum() and text[end].isalnum()
                if not joined:
                    held.update(places)
            out = [(n, 0) for n in sorted(held)]
        spans: dict[int, list[list[int]]] = {}
        if self.any:
            for end, (size, places) in self.automaton.iter(text):
                hit = end + 1 - size
                for n, at, above in places:
                    if any(self.nearest(part, text[max(0, hit - left - e) : hit + right + e]) > e for left, right, e, part in above):
                        continue
                    start = hit - at
                    a, b = max(0, start - self.k[n]), start + len(self.items[n]) + self.k[n]
                    own = spans.setdefault(n, [])
                    own.append([a, b])
        for n, own in spans.items():
            own.sort()
            best, m, k = len(self.items[n]), len(self.items[n]), self.k[n]
            a, b = own[0]
            for x, y in [*own[1:], [len(text) + 1 + m, 0]]:
                if x <= b:
                    b = max(b, y)
                    continue
                best = min(best, self.nearest(self.items[n], text[a:b]))
                if not best:
                    break
                a, b = x, y
            if best <= k:
                out.append((n, best))
        return out


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple]]:
    """Ids and texts of the items, in blocks of about block_chars characters; one block at least."""
    held, size, any_ = [], 0, False
    for row in items.filter(F.col(item_text).isNotNull()).select(item_id, item_text).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_chars:
            yield held
            held, size, any_ = [], 0, True
    if held or not any_:
        yield held


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, in_words: bool = False) -> DataFrame:
    """The rows of docs that hold no item; each block of items filters what the last one left."""
    at = docs.columns.index(text_col)
    for block in item_blocks(items, item_id, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast([x[1] for x in block])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate, in_words)
            for batch in batches:
                keep = [not (text and matcher.search(text)) for text in texts_of(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, in_words: bool = False) -> DataFrame:
    """docs' columns but the text, plus item_id and errors: a row for each item that a document holds."""
    base = without(docs, *({"item_id", "errors"} - {text_col}))
    kept = [c for c in base.columns if c != text_col]
    base = base.select(*kept, F.col(text_col).alias("__text"))
    id_type = items.schema[item_id].dataType
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("item_id", id_type), T.StructField("errors", T.IntegerType())])
    spark, out = docs.sparkSession, None

    def of(block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = [x[0] for x in sent.value], [x[1] for x in sent.value]
            matcher = Matcher(texts, rate, in_words)
            for batch in batches:
                rows, found, errors = [], [], []
                for i, text in enumerate(texts_of(batch.column(len(kept)))):
                    for n, e in matcher.search(text) if text else ():
                        rows.append(i)
                        found.append(ids[n])
                        errors.append(e)
                if rows:
                    part = batch.select(list(range(len(kept)))).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(found, to_arrow_type(id_type)), pa.array(errors, pa.int32())], names=[*part.schema.names, "item_id", "errors"]
                    )

        return map_arrow(base, run, schema)

    for block in item_blocks(items, item_id, item_text, block_chars):  # the driver holds one block of items at a time
        out = of(block) if out is None else out.unionByName(of(block))
    return out


