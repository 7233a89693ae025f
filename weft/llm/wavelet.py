"""Token shards as wavelet matrices.

A shard holds the token ids of consecutive documents. Its ids are kept as bit planes, the
highest bit first; before each next plane the ids are stably parted by the bit just written
(zeros first). With ones counted at every BLOCK bits, rank and select on the planes give token
access, counts of an id in any range, and the places where it occurs, without decoding the rest.

File format (little-endian). A shard's image is: magic `WMX1`; unsigned 32-bit header length;
the header as JSON {n, docs, planes, sections: [[name, stored bytes], ...]}; then the sections,
each one zstd frame: `doc_ids` (int64), `doc_null` (uint8), `lengths` (int64, ids of each
document), `zeros` (int64, zeros in each plane), `ranks` (uint32, per plane the ones before
each BLOCK bits) and `plane0`.. (bits, the first in the lowest bit of a byte). A table of
shards is written with Spark's commit protocol, one file for each range of documents, whose
rows are (part, seq, first_doc, n_docs, n_tokens, image); lost or repeated tasks leave no
half-written shard.

Defined results: a null text is encoded as empty; null ids come first; rows that repeat an id
stay separate, ordered by text; an empty table gives no shard. Columns beyond the id and the
text aren't stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import map_arrow, texts_of
from weft.llm.memory import Memory

MAGIC = b"WMX1"
BLOCK = 512
#: A shard is closed once it holds this many ids; one longer document makes a longer shard.
SHARD_TOKENS = 1 << 20
#: Runs of punctuation whose ids a worker remembers.
TAILS = 100_000
#: Cores that are encoded in one text.
GROUP = 64
SHARD_SCHEMA = "part int, seq int, first_doc long, n_docs long, n_tokens long, image binary"

#: A run of Latin letters and one of ASCII punctuation: what the pre-tokeniser parts in two.
PLAIN = re.compile(r"([A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)")

_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file; later tasks find its memory warm."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    A tokenizer whose normaliser and pre-tokeniser look at no more than a run between blanks,
    and drop the blanks, gives a text the ids of its words one after another. worded() tells
    whether the file is of that kind; texts of other tokenizers are encoded as they are. Words
    of Latin letters, with punctuation at most behind them, are encoded by the file's model
    alone, for what comes before the model only lower-cases them and maps their bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = worded(spec)
        self.by_core = self.by_word and {"type": "Lowercase"} in (spec["normalizer"] or {}).get("normalizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        # cores are encoded many to a text, parted by blanks; a core ends with the one id that has the suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if self.by_core and suffix:
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = "".join(map(chr, range(0x80, 0x250)))
        self.bytes = {ord(c): "".join(x for x, _ in shown.pre_tokenize_str(c)) for c in letters}
        self.tails: dict[str, bytes] = {"": b""}
        self.memory = Memory(self._learn)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _cores(self, cores: list[str]) -> dict[str, bytes]:
        """Ids of runs of lower-case letters, by the model alone."""
        found = {}
        for k in range(0, len(cores), 64 * GROUP):
            own = cores[k : k + 64 * GROUP]
            shown = [c if c.isascii() else c.translate(self.bytes) for c in own]
            texts = [" ".join(shown[i : i + GROUP]) for i in range(0, len(own), GROUP)]
            flat = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)), dtype="<u4")
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == len(own):
                data, cuts = flat.tobytes(), [0, *(4 * ends).tolist()]
                found.update(zip(own, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:
                found.update((c, array("I", self.bare.encode(x, add_special_tokens=False).ids).tobytes()) for c, x in zip(own, shown, strict=True))
        return found

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [w.decode("utf-8", "surrogatepass") for w in raw]
        parts = [PLAIN.fullmatch(w) for w in words] if self.by_core else [None] * len(words)
        parts = [(m[1].lower(), m[2]) if m and "\u0130" not in m[1] else None for m in parts]
        other = [w for w, p in zip(words, parts, strict=True) if p is None]
        others = iter(self.tokenizer.encode_batch_fast(other, add_special_tokens=False))
        cores, tails = self._cores(list({p[0] for p in parts if p})), self.tails
        if len(tails) > TAILS:
            tails = self.tails = {"": b""}
        for t in {p[1] for p in parts if p}.difference(tails):
            tails[t] = self._library(t)
        made = [cores[p[0]] + tails[p[1]] if p else array("I", next(others).ids).tobytes() for p in parts]
        return np.frombuffer(b"".join(made), dtype="<u4"), np.array([len(m) // 4 for m in made], dtype=np.int64)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each text has."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), dtype="<u4"), np.array([len(x) for x in found], dtype=np.int64)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b" ".join([b"", *raw, b""])
        codes = np.frombuffer(data, dtype=np.uint8)
        blank = (codes == 32) | (codes == 10)
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        ids, size = self.memory.encode(data, starts, ends)
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        ids, size = self.encode_flat(texts)
        data, cuts = ids.astype("<u4").tobytes(), np.cumsum([0, *(4 * size).tolist()]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def worded(spec: dict) -> bool:
    """True if encoding word by word, parted at blanks and line feeds, gives the same ids."""

    def steps(x, key):
        return [] if x is None else [y for z in x[key] for y in steps(z, key)] if x["type"] == "Sequence" else [x]

    norm, pre = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    kinds = {"NFC", "Lowercase"}
    if any(s["type"] not in kinds and not (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in norm):
        return False
    if spec.get("post_processor") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"]):
        return False
    split = pre[:1] and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    # the kept runs: fixed strings without blanks, letters, a digit, or anything but blanks, letters and digits
    runs = split and all(p in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") or p.replace("'", "").isalpha() for p in pre[0]["pattern"].get("Regex", " ").split("|"))
    return bool(runs) and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in pre[1:])


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's image."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zeros, ranks, bits = [], [], []
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for level in range(planes):
        bit = (seq >> (planes - 1 - level) & 1).astype(bool)
        bits.append(np.packbits(bit, bitorder="little"))
        ones = np.bitwise_count(bits[-1])
        ones = np.concatenate([ones, np.zeros(-len(ones) % (BLOCK // 8), np.uint8)]).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks.append(np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype("<u4"))
        zeros.append(len(bit) - int(ranks[-1][-1]))
        seq = np.concatenate([seq[np.flatnonzero(~bit)], seq[np.flatnonzero(bit)]])
    sections = [
        ("doc_ids", np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()),
        ("doc_null", np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()),
        ("lengths", np.array(lengths, dtype="<i8").tobytes()),
        ("zeros", np.array(zeros, dtype="<i8").tobytes()),
        ("ranks", np.concatenate(ranks).tobytes()),
        *[(f"plane{k}", b.tobytes()) for k, b in enumerate(bits)],
    ]
    press = zstandard.ZstdCompressor(level=1)
    stored = [(name, press.compress(data)) for name, data in sections]
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "planes": planes, "sections": [[n, len(s)] for n, s in stored]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *[s for _, s in stored]])


class WaveletMatrix:
    """A shard read back from its image; planes are expanded when first used."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<I", image, 4)
        head = json.loads(image[8 : 8 + size])
        self.n, self.docs, self.planes = head["n"], head["docs"], head["planes"]
        self.stored, at = {}, 8 + size
        for name, length in head["sections"]:
            self.stored[name] = image[at : at + length]
            at += length
        if at != len(image):
            raise ValueError("a token shard of the wrong length")
        self.lengths = np.frombuffer(self._section("lengths"), dtype="<i8")
        self.ends = np.cumsum(self.lengths)
        self.zeros = np.frombuffer(self._section("zeros"), dtype="<i8")
        self.ranks = np.frombuffer(self._section("ranks"), dtype="<u4").reshape(self.planes, -1)
        self._bits: dict[int, np.ndarray] = {}

    def _section(self, name: str) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.stored[name])

    def doc_ids(self) -> list:
        ids, null = np.frombuffer(self._section("doc_ids"), dtype="<i8").tolist(), self._section("doc_null")
        return [None if z else d for d, z in zip(ids, null, strict=True)]

    def bits(self, level: int) -> np.ndarray:
        if level not in self._bits:
            self._bits[level] = np.frombuffer(self._section(f"plane{level}"), dtype=np.uint8)
        return self._bits[level]

    def bit(self, level: int, i: int) -> int:
        return int(self.bits(level)[i >> 3]) >> (i & 7) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        part = self.bits(level)[block * BLOCK // 8 : (i + 7) // 8]
        ones = np.unpackbits(part, bitorder="little")[: i - block * BLOCK].sum(dtype=np.int64) if len(part) else 0
        return int(self.ranks[level][block]) + int(ones)

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.bits(level)[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.planes):
            bit, ones = self.bit(level, i), self.rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.planes:
            return 0, 0
        for level in range(self.planes):
            a, b = self.rank1(level, start), self.rank1(level, end)
            if token >> (self.planes - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs among places start to end, the end excluded."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - level) & 1
            i = self.select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, by putting the planes' partings back from the last to the first."""
        low = np.zeros(self.n, dtype=np.uint16 if self.planes <= 16 else np.uint32)
        for level in reversed(range(self.planes)):
            bit = np.unpackbits(self.bits(level), count=self.n, bitorder="little").view(bool)
            back, z = np.empty_like(low), int(self.zeros[level])
            low[z:] |= low.dtype.type(1 << (self.planes - 1 - level))
            back[np.flatnonzero(~bit)] = low[:z]
            back[np.flatnonzero(bit)] = low[z:]
            low = back
        return low.astype("<u4")


def build_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows of SHARD_SCHEMA: documents in ascending id order, each followed by end_id.

    One range shuffle of the texts; ids are made after it and never shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange("d").sortWithinPartitions("d", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, sizes, made, held = [], [], [], 0

        def shard():
            nonlocal seq, ids, sizes, made, held
            image = pack(ids, sizes, np.concatenate(made))
            out = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_doc": pa.array([ids[0]], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "image": pa.array([image], pa.binary())}
            )
            seq, ids, sizes, made, held = seq + 1, [], [], [], 0
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            flat, size = words.encode_flat(texts)
            flat = np.insert(flat, np.cumsum(size), end_id)
            at = 0
            for d, n in zip(doc_ids, (size + 1).tolist(), strict=True):
                ids.append(d)
                sizes.append(n)
                held += n
                made.append(flat[at : at + n])
                at += n
                if held >= shard_tokens:
                    yield shard()
        if ids:
            yield shard()

    return map_arrow(rows, run, SHARD_SCHEMA)


def write_shards(shards: DataFrame, path: str) -> None:
    shards.write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, start: the ids in all shards before this one. Only the small columns are read.

    Sums by part come first, so that the one ordered window has a row a part.
    """
    small = shards.select("part", "seq", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    own = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return small.join(base, "part").select("part", "seq", (F.col("base") + own).alias("start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards' images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                m = WaveletMatrix(batch.column(2)[k].as_py())
                data, ends = memoryview(m.tokens()).cast("B"), m.ends.tolist()
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.repeat(batch.column(0)[k], m.docs), "seq": pa.repeat(batch.column(1)[k], m.docs), "doc_id": pa.array(m.doc_ids(), pa.int64()), "at": pa.array(starts, pa.int64()), "n_tokens": pa.array(m.lengths), "ids_crc32": pa.array(crc, pa.int64())}
                )

    rows = map_arrow(shards.select("part", "seq", "image"), run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
