"""Words of text without blanks: the best path through the lattice of a lexicon's words.

A run is a string without word breaks (ideographs, or words written together). Its lattice has an edge
for every place where a word of the lexicon stands, and one for each character as an unknown word. The
path of the greatest sum of weights is taken; among equal ones that of fewer words, then that whose
last word is longer, and so on backwards.

The lexicon is a table. Up to SENT_BYTES it goes to the tasks as one trie (with failure links, so that
all edges of a run are found in one pass over it), and texts aren't shuffled at all. Of a larger one
the shortest words, which stand nearly everywhere, go so, and the rest is joined: of the runs' pieces
of the rest's lengths those meet the words by equality of which a map of fixed size holds all PROBES
bits (of 10 million words it lets a thousandth of other pieces through). A piece travels with a short
key of its list of runs, and what it meets goes back to that list, so that runs are shuffled by list
only. Both ways give the same words. A null list of runs gives a null list, an empty or null run no
words.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as tx
from weft.operators.batches import bounded
from weft.sources.tables import kept

#: Bytes of words (with 16 for each weight) that may be sent to every task.
SENT_BYTES = 16 << 20
#: Bits of the map of joined words, how many of them a word sets, and characters of the runs whose pieces are made at once.
MAP_BITS, PROBES, BLOCK = 1 << 28, 4, 1 << 18
#: Weights are thousandths of a natural logarithm, rounded down, so that sums are exact.
SCALE = 1000


@dataclass(frozen=True)
class Lexicon:
    """rows: word (unique), weight. unknown: the weight of a character that is no word."""

    rows: DataFrame
    unknown: int


def lexicon(words: DataFrame, word: str = "word", count: str = "count") -> Lexicon:
    """Words weighted by the logarithm of their share of all counts, an unknown character as if counted once. Empty words and counts under 1 are left out. The words are counted once and kept."""
    n = words.groupBy(F.col(word).alias("word")).agg(F.sum(count).cast("long").alias("n")).filter("word <> '' AND n > 0")
    n = kept(n, "lexicon")
    total = float(n.agg(F.sum("n")).first()[0] or 1)
    return Lexicon(n.select("word", F.floor(SCALE * F.ln(F.col("n") / F.lit(total))).cast("long").alias("weight")), math.floor(SCALE * math.log(1 / total)))


def best_path(run: str, edges: Iterable[tuple[int, int, int]], unknown: int, search: bool = False) -> list[str]:
    """The words of a run. edges: (start, end, weight) by ascending end. With `search`, words of two and three characters inside a longer one come before it."""
    edges = list(edges)
    best, back, e = [(0, 0)], [0], 0
    for end in range(1, len(run) + 1):
        score, words = best[end - 1]
        top = (score + unknown, words - 1, 1 - end)
        while e < len(edges) and edges[e][1] == end:
            start, _, weight = edges[e]
            score, words = best[start]
            top = max(top, (score + weight, words - 1, -start))
            e += 1
        best.append(top[:2])
        back.append(-top[2])
    spans, end = [], len(run)
    while end:
        spans.append((back[end], end))
        end = back[end]
    spans.reverse()
    if not search:
        return [run[a:b] for a, b in spans]
    inner = {(a, b) for a, b, _ in edges if b - a in (2, 3)}
    out = []
    for a, b in spans:
        out += [run[k : k + n] for n in (2, 3) if n < b - a for k in range(a, b - n + 1) if (k, k + n) in inner]
        out.append(run[a:b])
    return out


def _with_column(df: DataFrame, name: str, kind: T.DataType, source: list[str], make: Callable[[list], Callable[..., object]], sent) -> DataFrame:
    """df without the source columns and with a column made from each row's of them; `make` is called once a task."""
    bounded(df.sparkSession)
    stay = [f for f in df.schema.fields if f.name not in source]
    n = len(stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        row = make(sent.value)
        for batch in batches:
            made = [row(*values) for values in zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, to_arrow_type(kind))], names=[*(f.name for f in stay), name])

    return df.select(*[f"`{f.name}`" for f in stay], *source).mapInArrow(run, T.StructType([*stay, T.StructField(name, kind)]))


WORDS = T.ArrayType(T.StringType())


def segment(df: DataFrame, runs: str, words: Lexicon, out: str = "words", search: bool = False, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """df with, in `out`, a list of words for each run of the list `runs`."""
    sizes = words.rows.groupBy(F.length("word").alias("n")).agg(F.sum(F.octet_length("word") + 16).alias("bytes")).collect()  # a row for each length of a word
    longest, size = 0, 0
    for n, more in sorted(map(tuple, sizes)):
        size += more
        if size > sent_bytes:
            return _by_join(df, runs, words, out, search, longest, [x for x, _ in sizes if x > longest])
        longest = n
    return _by_trie(df, runs, words, out, search)


def _trie(known: list[tuple[str, int]]) -> Callable[[str], Iterator[tuple[int, int, int]]]:
    """A function that gives the edges of a run, by ascending end."""
    import ahocorasick

    trie = ahocorasick.Automaton()
    for word, weight in known:
        trie.add_word(word, (len(word), weight))
    trie.make_automaton()
    return lambda run: ((last + 1 - n, last + 1, weight) for last, (n, weight) in trie.iter(run)) if run and known else iter(())


def _sent(words: DataFrame):
    return words.sparkSession.sparkContext.broadcast([tuple(r) for r in words.select("word", "weight").toLocalIterator()])


def _by_trie(df: DataFrame, runs: str, words: Lexicon, out: str, search: bool) -> DataFrame:
    unknown = words.unknown

    def make(known: list[tuple[str, int]]) -> Callable[..., object]:
        edges = _trie(known)
        return lambda given: None if given is None else [best_path(r or "", edges(r), unknown, search) for r in given]

    return _with_column(df.withColumn("__runs", F.col(runs)), out, T.ArrayType(WORDS), ["__runs"], make, _sent(words.rows))


def _hashed(text: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """length, hashes of all pieces of that length, for each of the ascending lengths."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed, wanted = np.zeros(len(points), np.uint64), set(lengths)
    for n in range(1, min(max(lengths, default=0), len(points)) + 1):
        mixed = mixed[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1)
        if n in wanted:
            x = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield n, x ^ (x >> np.uint64(32))


def _place(hashes: np.ndarray, probe: int) -> np.ndarray:
    """One of the PROBES places in the map that belong to each hash."""
    return (((hashes >> np.uint64(32)) + np.uint64(probe) * (hashes | np.uint64(1))) & np.uint64(MAP_BITS - 1)).astype(np.int64)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have all their bits in the map."""
    found = np.arange(len(hashes))
    for k in range(PROBES):
        at = _place(hashes[found], k)
        found = found[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    return found


def _map(words: DataFrame) -> np.ndarray:
    """The bits of all words' hashes, by the byte; of one size however many words there are."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).to_pylist()
            size = np.array([*map(len, known)])
            start = np.cumsum(size) - size
            for n, hashes in _hashed("".join(known), sorted({*size.tolist()})):
                own = hashes[start[size == n]]
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.concatenate([_place(own, k) for k in range(PROBES)]))})

    at = words.select("word").mapInArrow(place, "at long")
    at = at.select((F.col("at") + 1).alias("at"))  # Spark counts places from 1, buckets of 4096 bytes too
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    whole = np.zeros(MAP_BITS // 8, np.uint8)
    for n, bits in rows.toLocalIterator():
        part = np.frombuffer(bytes(bits), np.uint8)
        whole[(n - 1) * 4096 : (n - 1) * 4096 + len(part)] = part
    return whole


def _pieces(lists: DataFrame, words: DataFrame, lengths: list[int]) -> DataFrame:
    """key, start (in the list's runs put together), word: pieces of the runs that may be words; those of other lengths or without their bits in the map are none."""
    bounded(lists.sparkSession)
    sent = words.sparkSession.sparkContext.broadcast(_map(words))
    lengths = sorted(lengths)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            each = batch.column(1).to_pylist()
            runs = [r or "" for x in each for r in x]
            row = np.repeat(np.arange(len(each)), [len(x) for x in each])
            begin = np.cumsum([0, *map(len, runs)])
            offset = begin[:-1] - begin[np.searchsorted(row, row)]  # of a run in its list
            for part in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(begin[:-1] // BLOCK)) + 1):
                if not len(part):
                    continue
                at = begin[part[0] : part[-1] + 2] - begin[part[0]]
                text = "".join(runs[i] for i in part)
                for n, hashes in _hashed(text, lengths):
                    start = _held(bits, hashes)
                    run = np.searchsorted(at, start, "right") - 1
                    inside = start + n <= at[run + 1]
                    start, run = start[inside], run[inside]
                    if len(start):
                        own = (start - at[run] + offset[part[0] + run]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part[0] + run])), pa.array(own), pa.array([text[x : x + n] for x in start.tolist()])], names=["key", "start", "word"])

    return lists.select("key", "runs").mapInArrow(cut, "key binary, start int, word string")


def _by_join(df: DataFrame, runs: str, words: Lexicon, out: str, search: bool, longest: int, lengths: list[int]) -> DataFrame:
    """Words of up to `longest` characters go to the tasks, longer ones (of these lengths) are joined."""
    unknown = words.unknown
    marked = df.withColumn("__list", F.unhex(F.left(F.sha2(F.to_json(runs), 256), F.lit(32))))
    lists = marked.filter(F.col("__list").isNotNull()).groupBy(F.col("__list").alias("key")).agg(F.first(runs).alias("runs"))

    # sorted joins: Spark takes the sizes of pieces and paths for those of the files behind them and would send them to all
    long = words.rows.filter(F.length("word") > longest)
    edges = _pieces(lists, long, lengths).hint("merge").join(long, "word").select("key", (F.col("start") + F.length("word")).alias("end"), "start", "weight")
    # dealt as they are: few of a list's edges lie in one task, so gathering there would only make them longer
    edges = edges.repartition("key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("end", "start", "weight"))).alias("edges"))

    def make(known: list[tuple[str, int]]) -> Callable[..., object]:
        short = _trie(known)

        def paths(given: list[str | None], found: list[dict] | None) -> list[list[str]]:
            said, at, e, found = [], 0, 0, found or []
            for run in given:
                run, first = run or "", e
                while e < len(found) and found[e]["end"] <= at + len(run):
                    e += 1
                joined = [(x["start"] - at, x["end"] - at, x["weight"]) for x in found[first:e]]
                said.append(best_path(run, heapq.merge(short(run), joined, key=lambda x: x[1]), unknown, search))
                at += len(run)
            return said

        return paths

    paths = _with_column(lists.join(edges.hint("merge"), "key", "left"), out, T.ArrayType(WORDS), ["runs", "edges"], make, _sent(words.rows.filter(F.length("word") <= longest)))
    return marked.drop(out).join(paths.withColumnRenamed("key", "__list").hint("merge"), "__list", "left").drop("__list")


def mixed_words(df: DataFrame, text: str, words: Lexicon, out: str = "tokens") -> DataFrame:
    """df with the tokens of a mixed text: the words of its ideograph runs, each with its pairs, then Latin tokens not seen yet. `mixed_tokens` is the way without a lexicon."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    rows = segment(df.withColumn("__ideographs", tx.matches(low, f"[{tx.CJK}]+")), "__ideographs", words, "__words", search=True)
    none = F.array().cast("array<string>")
    found = F.flatten(F.transform(F.flatten("__words"), lambda w: F.concat(F.array(w), F.when(F.length(w) > 1, tx.pairs_of(w)).otherwise(none))))
    return rows.withColumn(out, _then_latin(found, low)).drop("__ideographs", "__words")


def _then_latin(found: Column, low: Column) -> Column:
    latin = F.filter(tx.latin_tokens(F.regexp_replace(low, f"[{tx.CJK}]+", " ")), lambda w: w != "")
    return F.concat(found, F.array_except(latin, found))
