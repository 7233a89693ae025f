"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A letter trigram is
the product (binding) of its letters' vectors, the first rotated twice and the second once. A
text's vector is the sum (bundle) of its trigrams' vectors, a language's prototype the sum of
its training texts' vectors, and a text gets the language whose prototype has the highest
cosine with it. Words are lower-cased and padded with one blank on either side; all that is
not a letter separates words.

Defined results: a null or empty text, or one without a letter, gets `und` and score 0; so
does every text if there is nothing to learn from. Equal cosines go to the language that sorts
first. A repeated row counts each time. Columns named lang_pred or score are replaced; all
others are kept.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import append_columns, map_arrow, texts_of

DIM = 1024
SEED = 20240517
#: The prototypes go to every task, so their number is checked against this.
MAX_LANGUAGES = 4096
#: Trigram vectors kept by a task for reuse; beyond it they are made anew.
CACHE_ROWS = 24_576
BATCH_CHARS = 60_000
#: Longer texts are bundled in parts, cut at blanks: trigrams don't cross these.
PART_CHARS = 1_000_000
#: Alphabets up to this many letters use a dense trigram table.
DENSE = 160


class Encoder:
    """Turns batches of texts into counts of letter trigrams and their vectors."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.index = np.full(0x110000, -1, dtype=np.int32)  # code point -> place in the alphabet, 0: not a letter
        self.letters = [self._random(32)]
        self.reset()

    def _random(self, code: int) -> np.ndarray:
        bits = np.random.Generator(np.random.Philox(key=self.seed, counter=[code, 0, 0, 0])).integers(0, 2, self.dim)
        return (2 * bits - 1).astype(np.int8)

    def reset(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dim), dtype=np.int8)
        self.dense = np.full(DENSE**3, -1, dtype=np.int32)

    def _learn(self, codes: np.ndarray) -> None:
        for c in np.unique(codes):
            if chr(c).isalpha():
                self.index[c] = len(self.letters)
                self.letters.append(self._random(int(c)))
            else:
                self.index[c] = 0

    def _row(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the vectors of these distinct trigram keys, made if they are new."""
        out = np.empty(len(keys), dtype=np.int32)
        for k, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                if row >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                self.vectors[row] = np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]
            out[k] = row
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A dense matrix of counts (text by trigram) and the vectors' rows of its columns."""
        if len(self.rows) > CACHE_ROWS:
            self.reset()
        low = [unicodedata.normalize("NFC", t).lower() for t in texts]
        codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
        place = self.index[codes]
        if (unseen := place < 0).any():
            self._learn(codes[unseen])
            place = self.index[codes]
        keep = np.ones(len(place), dtype=bool)
        keep[1:] = (place[1:] != 0) | (place[:-1] != 0)
        owner = np.append(owner, len(low) - 1 if low else 0)[keep]
        place = place[keep].astype(np.int64)
        a, b, c = place[:-2], place[1:-1], place[2:]
        mid = b != 0
        a, b, c, owner = a[mid], b[mid], c[mid], owner[1:-1][mid]
        if not len(b):
            return np.zeros((len(texts), 0), dtype=np.float32), np.zeros(0, dtype=np.int32)
        if len(self.letters) <= DENSE:
            key = (a * DENSE + b) * DENSE + c
            row = self.dense[key]
            if (new := row < 0).any():
                fresh = np.unique(key[new])
                self.dense[fresh] = self._row(fresh // DENSE**2 << 42 | fresh // DENSE % DENSE << 21 | fresh % DENSE)
                row = self.dense[key]
        else:
            fresh, inverse = np.unique(a << 42 | b << 21 | c, return_inverse=True)
            row = self._row(fresh)[inverse]
        seen = np.zeros(len(self.rows), dtype=bool)
        seen[row] = True
        used = np.flatnonzero(seen)
        local = np.empty(len(self.rows), dtype=np.int64)
        local[used] = np.arange(len(used))
        flat = np.bincount(owner * len(used) + local[row], minlength=len(texts) * len(used))
        return flat.reshape(len(texts), len(used)), used

    def bundle(self, texts: list[str]) -> np.ndarray:
        """The texts' vectors, exact integers; a long text's is the sum of its parts', so memory is bounded by a part."""
        if any(len(t) > PART_CHARS for t in texts):
            return np.stack([sum(self._bundle([part])[0] for part in parted(t)) for t in texts])
        return self._bundle(texts)

    def _bundle(self, texts: list[str]) -> np.ndarray:
        counts, used = self.counts(texts)
        if counts.size and counts.max() * counts.shape[1] < 2**23:
            return (counts.astype(np.float32) @ self.vectors[used].astype(np.float32)).astype(np.float64)
        return counts.astype(np.float64) @ self.vectors[used].astype(np.float64)


def parted(text: str):
    """The text in parts of about PART_CHARS characters that end at a blank; one part at least."""
    start = 0
    while len(text) - start > PART_CHARS and (cut := text.find(" ", start + PART_CHARS)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


def batches_of(texts: list[str]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BATCH_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: names in order, and a row of `dim` integers for each."""

    names: tuple[str, ...]
    prototypes: np.ndarray
    dim: int = DIM
    seed: int = SEED

    def predict(self, encoder: Encoder, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found, score = [], np.zeros(len(texts))
        unit = self.prototypes / np.maximum(np.linalg.norm(self.prototypes, axis=1, keepdims=True), 1e-12) if self.names else None
        for a, b in batches_of(texts):
            if unit is None:
                found += ["und"] * (b - a)
                continue
            vec = encoder.bundle(texts[a:b])
            norm = np.linalg.norm(vec, axis=1)
            cos = np.round(vec @ unit.T / np.maximum(norm, 1e-12)[:, None], 12)
            best = cos.argmax(axis=1)
            found += [self.names[k] if n else "und" for k, n in zip(best, norm, strict=True)]
            score[a:b] = np.where(norm > 0, np.clip(cos.max(axis=1), 0, 1), 0)
        return found, score


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> Profiles:
    """Prototypes of the languages in rows; rows with a null language teach nothing.

    Each task sends one partial sum a language; the sums meet by language and dimension.
    """

    def partial(batches):
        encoder, sums = Encoder(dim, seed), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = texts_of(batch.column(0))
            for a, b in batches_of(texts):
                vec = encoder.bundle(texts[a:b])
                own = np.array(langs[a:b])
                for lang in set(langs[a:b]):
                    sums[lang] = sums.get(lang, 0) + vec[own == lang].sum(axis=0)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].astype(np.int64) for n in names], pa.list_(pa.int64()))], names=["lang", "vec"]
        )

    known = rows.filter(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col))
    parts = map_arrow(known, partial, "lang string, vec array<long>")
    sums = parts.select("lang", F.posexplode("vec").alias("pos", "x")).groupBy("lang", "pos").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    proto = np.array([[p["x"] for p in r["v"]] for r in found], dtype=np.float64).reshape(len(found), dim)
    return Profiles(tuple(r["lang"] for r in found), proto, dim, seed)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score."""
    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        encoder = Encoder(profiles.dim, profiles.seed)

        def apply(texts):
            found, score = profiles.predict(encoder, texts)
            return {"lang_pred": pa.array(found, pa.string()), "score": pa.array(score, pa.float64())}

        return apply

    return append_columns(docs, text_col, new, make)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
