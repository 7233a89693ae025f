"""SentencePiece models on the tokenizers library.

The model file's protobuf is read directly: pieces with scores and kinds, the trainer's type,
the normaliser's options and its compiled character map. From these a tokenizer is rebuilt:
unigram scores, or merges in the order of the pieces' scores; byte fallback; the marker U+2581
for blanks, put in front of a text if the model says so. Texts are encoded in batches by the
library's threads.

Where no piece holds a marker behind another character, pieces never cross the place before a
run of markers, so a text's ids are those of its parts between such places; where no piece
holds a line feed, it parts too. Each distinct part, line feeds and what follows them included,
is then encoded once, many parts to a text with line feeds between them: by the rebuilt
tokenizer with its normaliser and by the sentencepiece library (parity), and decoded by the
rebuilt decoder. Should a part's ids differ, its texts take SentencePiece's ids and are flagged.
Models of another kind are encoded, checked and decoded by whole texts.

Defined results: null and empty texts have no ids, decode to an empty text and are flagged as
in parity; a literal U+2581 reads as a blank, so such a text doesn't come back the same (round
trip false). Columns n_tokens, tokens, parity and round_trip are replaced.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm.common import append_columns, map_arrow
from weft.llm.memory import Memory, gather

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
THREADS = 2
#: New parts that are encoded in one text.
GROUP = 64
#: Parts that may differ before texts are encoded and checked as a whole.
MOST_ODD = 100_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool  # extra white space is removed

    @staticmethod
    def read(path: str) -> Model:
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        pieces = []
        for number, value in message:
            if number == 1:
                x = dict(fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0], x.get(3, NORMAL)))
        trainer = dict(fields(dict(message).get(2, b"")))
        norm = dict(fields(dict(message).get(3, b"")))
        return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)))

    @property
    def parted(self) -> bool:
        """Whether texts can be encoded part by part."""
        return self.kind == BPE and self.byte_fallback and not self.charsmap and not self.squeeze and self.dummy_prefix and not any(re.search(f"[^{MARK}]{MARK}|\n", p) or k == USER for p, _, k in self.pieces if k != CONTROL)


def rebuild(model: Model):
    """A tokenizer of the tokenizers library that does what the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unk = next(i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unk, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        merges = []
        score = {p: s for p, s, k in model.pieces if k in (NORMAL, USER)}
        for p, s in score.items():
            for i in range(1, len(p)):
                if p[:i] in score and p[i:] in score:
                    merges.append((-s, vocab[p], vocab[p[:i]], p[:i], p[i:]))
        merges.sort(key=lambda m: m[:3])
        core = models.BPE(vocab, [m[3:] for m in merges], unk_token=model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are known")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else back)
    user = [AddedToken(p, normalized=False) for p, _, k in model.pieces if k == USER]
    if user:
        tok.add_tokens(user)
    return tok


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


class Codec:
    """Encodes and decodes batches of texts, and holds what it does to the sentencepiece library."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = Model.read(path)
        self.tok = rebuild(self.model)
        self.spm = sentencepiece.SentencePieceProcessor(model_file=path)
        self.parted = self.model.parted
        self.memory = Memory(self._learn)
        self.odd: set[bytes] = set()  # parts that the sentencepiece library encodes otherwise
        self.bent: set[bytes] = set()  # parts that the rebuilt decoder doesn't give back
        # what each piece stands for: a byte, nothing, or its characters with blanks for markers
        shown = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        self.bytes = [shown.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, _, k in self.model.pieces]
        self.width = np.array([1 if k == BYTE else len(p.encode()) for p, _, k in self.model.pieces], dtype=np.int64)

    def parts(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of all texts, the starts of their parts, and each text's first part.

        A text has a blank put in front; a part is a run of blanks with what follows it up to the next
        blank or line feed, a line feed, or what follows one.
        """
        raw = [b" " + t.replace(MARK, " ").encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = b"".join(raw)
        begin = np.cumsum([0, *map(len, raw)])
        codes = np.frombuffer(data, dtype=np.uint8)
        blank, feed = codes == 32, codes == 10
        cut = blank | feed
        cut[1:] &= ~(blank[1:] & blank[:-1])
        cut[1:] |= feed[:-1]
        cut[begin[:-1][begin[:-1] < len(codes)]] = True
        starts = np.flatnonzero(cut)
        return data, starts, np.searchsorted(starts, begin)

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[str]]:
        """Ids by the rebuilt tokenizer, ids by the sentencepiece library, and the first ones decoded."""
        mine = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return mine, self.spm.encode(texts, num_threads=THREADS), self.tok.decode_batch(mine, skip_special_tokens=False)

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new parts, each behind a line feed and many in a text; the texts' ids are cut where the parts' bytes end."""
        done = [self._some(parts[k : k + 20_000]) for k in range(0, len(parts), 20_000)]
        return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def _some(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [(b"\n" + b"\n".join(parts[k : k + GROUP])).decode("utf-8", "surrogatepass") for k in range(0, len(parts), GROUP)]
        mine, theirs, back = self._both(texts)
        if mine == theirs and back == texts:
            flat = np.fromiter(chain.from_iterable(mine), dtype=np.uint32)
            ends = np.concatenate([[0], np.cumsum(self.width[flat])])
            size = np.array([len(p) + (len(MARK.encode()) - 1) * p.count(b" ") for p in parts], dtype=np.int64)
            ahead = np.ones(len(parts), dtype=np.int64)  # a line feed, and the marker in front of a text
            ahead[::GROUP] += len(MARK.encode())
            stop = np.cumsum(size + ahead)
            a, b = np.searchsorted(ends, stop - size), np.searchsorted(ends, stop)
            if ends[-1] == stop[-1] and (ends[a] == stop - size).all() and (ends[b] == stop).all():
                return gather(flat, a, b - a), b - a
        if len(parts) > 1:  # some part is odd: look for it
            half = (len(parts) + 1) // 2
            (x, m), (y, n) = self._some(parts[:half]), self._some(parts[half:])
            return np.concatenate([x, y]), np.concatenate([m, n])
        if len(self.odd) + len(self.bent) > MOST_ODD:
            self.parted = False  # from the next texts on
        if mine[0] != theirs[0]:
            self.odd.add(parts[0])
        if back[0] != texts[0]:
            self.bent.add(parts[0])
        lead = self.tok.encode("\n", add_special_tokens=False).ids
        ids = np.array(mine[0][len(lead) :], dtype=np.uint32)
        return ids, np.array([len(ids)])

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as unsigned 32-bit integers, and whether the sentencepiece library agrees."""
        return self.checked(texts)[:2]

    def checked(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Also whether the rebuilt decoder gives all parts of a text again."""
        if not self.parted:
            mine, theirs, back = self._both(texts)
            return [array("I", y).tobytes() for y in theirs], [x == y for x, y in zip(mine, theirs, strict=True)], [x == y for x, y in zip(back, texts, strict=True)]
        data, starts, first = self.parts(texts)
        ends = np.append(starts[1:], len(data))
        ids, size = self.memory.encode(data, starts, ends)
        cuts = 4 * np.concatenate([[0], np.cumsum(size)])[first]
        flat = ids.astype("<u4").tobytes()
        out = [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        same, whole = [True] * len(texts), [True] * len(texts)
        if self.odd or self.bent:
            for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
                own = {data[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)}
                if not self.odd.isdisjoint(own):
                    out[i], same[i] = array("I", self.spm.encode(texts[i])).tobytes(), False
                whole[i] = self.bent.isdisjoint(own)
        return out, same, whole

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids: the pieces' bytes, less the marker put in front."""
        table = self.bytes.__getitem__
        out = []
        for data in ids:
            text = b"".join(map(table, memoryview(data).cast("I"))).decode("utf-8", "replace")
            out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
        return out


NEW = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())])


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs plus tokens, n_tokens, parity and round_trip (whether the decoded ids give the text again)."""

    def make():
        own = codec(model_path)

        def apply(texts):
            ids, same, back = [], [], []
            step = max(1, len(texts) * 400_000 // max(400_000, sum(map(len, texts))))
            for k in range(0, len(texts), step):
                part, ok, whole = own.checked(texts[k : k + step])
                ids += part
                same += ok
                back += [w and x == y for w, x, y in zip(whole, own.decode(part), texts[k : k + step], strict=True)]
            counts = [len(x) // 4 for x in ids]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            return {"tokens": pa.ListArray.from_arrays(offsets, flat), "n_tokens": pa.array(counts, pa.int64()), "parity": pa.array(same), "round_trip": pa.array(back)}

        return apply

    return append_columns(docs, text_col, NEW, make)


def decode(rows: DataFrame, model_path: str, tokens_col: str = "tokens", to: str = "text") -> DataFrame:
    """rows plus the texts of their ids; null ids give a null text."""
    from weft.llm.common import without

    base = without(rows, to) if to.lower() != tokens_col.lower() else rows
    schema = T.StructType([*base.schema.fields, T.StructField(to, T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(tokens_col)).to_pylist()
            texts = [None if x is None else own.decode([array("I", x).tobytes()])[0] for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return map_arrow(base, run, schema)
