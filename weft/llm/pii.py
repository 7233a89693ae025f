"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Base patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers,
leftmost and not overlapping within a kind. None of them can match across a line feed, nor in
a line without a digit or an at sign, so only such lines are looked at.

The field's nodes are the words of those lines that hold a digit or an at sign, and their
neighbours; all other words are held to be outside. Neighbouring words share a chain potential;
words that repeat or are alike (the same digits, the same last SUFFIX digits, the same address, or
the same name before an at sign) share a skip potential with their last occurrence in the
document, however far. The labels of base spans are taken as seen. Loopy sum-product messages, run over many documents at once, give each
word's label. Runs of words with the same label that touch no base span are added.

Weights are fitted (pseudo-likelihood, gradient ascent) to a bounded sample: the SAMPLE texts
with the least hashes among those with at most SAMPLE_CHARS characters and a digit or an at sign.
The base patterns label their words. Since these labels can be told from a word alone, each word
of the sample is also mentioned once more without what the patterns go by (bare digits, an address
without its domain's end), joined to the word by a skip edge alone: long ones with the word's
label, short numbers, which stand for much else, with none; and once as a stranger, joined to
no other mention and without a label. So the skip weights have to carry a label from a word that a pattern
finds to a mention that none does.

Defined results: a null or empty text has no span; without any sample document the field adds
nothing; repeated rows count each. Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import append_columns, map_arrow

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 400
SAMPLE_CHARS = 20_000
#: A word's label counts if its probability is at least this.
SURE = 0.5
ROUNDS = 30
#: What a base span adds to its words' potential of its label.
KNOWN = 20.0

HINT = re.compile("[0-9@]")
WORD = re.compile(r"\S+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(line: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from its at signs, so that long runs cost no more."""
    out, free, at = [], 0, line.find("@")
    while at >= 0:
        start = at
        while start > free and line[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(line, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = line.find("@", free)
    return out


def ips(line: str) -> list[tuple[int, int]]:
    """The lookbehind leaves out starts within a run of digits: from these the pattern can match only what it matches from the run's start."""
    return [m.span() for m in IP.finditer(line) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(line) if 16 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d)]


def phones(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(line) if 8 <= len(NOT_DIGITS.sub("", m[0])) <= 15]


FINDERS = (emails, ips, cards, phones)


def hinted_lines(text: str):
    """Start and string of each line with a digit or an at sign."""
    m = HINT.search(text)
    while m:
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.start())
        b = len(text) if b < 0 else b
        yield a, text[a:b]
        m = HINT.search(text, b)


FEATURES = 24
#: Words with the same last so many digits are alike.
SUFFIX = 7


def features(word: str, before: str, after: str) -> list[int]:
    """Places of the features that hold for a word and its neighbours in the line."""
    core = word.strip(".,;:!?\"'")
    n = len(DIGITS.findall(core))
    out = [0]
    if "@" in core:
        out.append(1)
        if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s.]+", core):
            out.append(2)
    if not n and "@" not in core:
        out.append(3)
    if n:
        out.append(4 + (n > 3) + (n > 6) + (n > 10) + (n > 15) + (n > 19))
        if core.isdigit():
            out.append(10)
        if 16 <= n <= 19:
            out.append(11 if luhn(NOT_DIGITS.sub("", core)) else 12)
        parts = core.split(".")
        if len(parts) == 4 and all(p.isdigit() for p in parts):
            out.append(13 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else 14)
    if core.startswith("+"):
        out.append(15)
    if "(" in core or ")" in core:
        out.append(16)
    if n and re.search("[0-9]-[0-9]", core):
        out.append(17)
    if re.search("[^\\W0-9_]", core):
        out.append(18)
    if before.startswith("+"):
        out.append(19)
    if "(" in before and HINT.search(before):
        out.append(20)
    if HINT.search(before):
        out.append(21)
    if HINT.search(after):
        out.append(22)
    if '"' in word:
        out.append(23)
    return out


def keys_of(word: str) -> list[str]:
    """What skip edges join: an address and its name, or the digits of a word with three or more, and the last SUFFIX of them."""
    if "@" in word:
        address = word.strip(".,;:!?\"'()<>").lower()
        return [address, address[: address.index("@") + 1]] if "@" in address else []
    digits = NOT_DIGITS.sub("", word)
    return ([digits] if len(digits) >= 3 else []) + ([f"~{digits[-SUFFIX:]}"] if len(digits) >= SUFFIX else [])


def mention(word: str) -> tuple[str, bool]:
    """A word without what the base patterns go by, and whether it still stands for the same; empty if there is none."""
    if "@" in word:
        name, _, domain = word.strip(".,;:!?\"'()<>").partition("@")
        return (f"{name}@{domain.split('.')[0]}", True) if name and domain else ("", False)
    digits = NOT_DIGITS.sub("", word)
    return (digits, len(digits) >= SUFFIX) if len(digits) >= 3 and word.count(".") < 3 else ("", False)


class Graph:
    """Words of many documents as nodes, with chain and skip edges."""

    def __init__(self):
        self.feats, self.labels, self.doc, self.span, self.chain, self.skip = [], [], [], [], [], []

    def add(self, doc: int, lines: list[tuple[int, str]], base: list[tuple[int, int, int]], mentions: bool = False) -> None:
        """A document's words; for fitting, each with a mention of it."""
        last: dict[str, int] = {}
        said: list[tuple[int, str]] = []
        base = sorted((a, b, k) for k, a, b in base)
        at = 0
        for start, line in lines:
            words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(line)]
            hint = [bool(HINT.search(w)) for _, _, w in words]
            before = -2
            for i, (a, b, w) in enumerate(words):
                if not (hint[i] or i and hint[i - 1] or i + 1 < len(words) and hint[i + 1]):
                    continue
                node, a, b = len(self.feats), a + start, b + start
                self.feats.append(features(w, words[i - 1][2] if i else "", words[i + 1][2] if i + 1 < len(words) else ""))
                while at < len(base) and base[at][1] <= a:
                    at += 1
                self.labels.append(next((k + 1 for x, y, k in base[at : at + 4] if x < b and a < y), 0))
                self.doc.append(doc)
                self.span.append((a, b))
                if before == i - 1:
                    self.chain.append((node - 1, node))
                before = i
                keys = keys_of(w) if hint[i] else []
                self.skip += [(n, node) for n in sorted({last[k] for k in keys if k in last})]
                last.update((k, node) for k in keys)
                if keys and mentions:
                    said.append((node, w))
        for node, w in said:
            word, same = mention(w)
            if word:
                self.skip.append((node, len(self.feats) + 1))
                for label in (self.labels[node] if same else 0, 0):  # between two plain words
                    at = len(self.feats)
                    self.chain += [(at, at + 1), (at + 1, at + 2)]
                    self.feats += [features("or", "", word), features(word, "or", "at"), features("at", word, "")]
                    self.labels += [0, label, 0]
                    self.doc += [doc] * 3
                    self.span += [(0, 0)] * 3

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.feats), FEATURES), dtype=np.float32)
        for i, f in enumerate(self.feats):
            x[i, f] = 1
        return x

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.chain, dtype=np.int64).reshape(-1, 2), np.array(self.skip, dtype=np.int64).reshape(-1, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass(frozen=True)
class Field:
    """Weights: node (feature by label), chain (label by label), skip (label by label, symmetric)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, graph: Graph, rounds: int = ROUNDS, tolerance: float = 1e-4, known: bool = False) -> np.ndarray:
        """Each node's label probabilities after loopy message passing, messages damped by half; known: labels of base spans are taken as seen."""
        pot = graph.matrix() @ self.node
        if known:
            seen = np.flatnonzero(graph.labels)
            pot[seen, np.array(graph.labels, dtype=np.int64)[seen]] += KNOWN
        chain, skip = graph.edges()
        src = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
        half, c = len(src) // 2, len(chain)
        if not half:
            return np.exp(pot - _lse(pot, 1)[:, None])
        msg = np.zeros((2 * half, pot.shape[1]))
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        order = np.argsort(dst, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], dst[order][1:] != dst[order][:-1]]))
        into = dst[order][heads]
        pair = np.empty((2 * half, *self.chain.shape))
        pair[:c], pair[c:half], pair[half : half + c], pair[half + c :] = self.chain, self.skip, self.chain.T, self.skip
        for _ in range(rounds):
            belief = pot.astype(np.float64)
            belief[into] += np.add.reduceat(msg[order], heads, axis=0)
            new = _lse((belief[src] - msg[back])[:, :, None] + pair, 1)
            new -= _lse(new, 1)[:, None]
            change = np.abs(new - msg).max()
            msg = 0.5 * (msg + new)
            if change < tolerance:
                break
        belief = pot.astype(np.float64)
        belief[into] += np.add.reduceat(msg[order], heads, axis=0)
        return np.exp(belief - _lse(belief, 1)[:, None])


def fit_graph(graph: Graph, steps: int = 300, rate: float = 0.5, penalty: float = 2e-4) -> Field:
    """Weights of greatest penalised pseudo-likelihood: each label given its neighbours' labels."""
    x, y, labels = graph.matrix(), np.array(graph.labels, dtype=np.int64), len(KINDS) + 1
    chain, skip = graph.edges()
    one = np.eye(labels)[y]
    left, right, same = (np.zeros((len(y), labels)) for _ in range(3))
    np.add.at(left, chain[:, 1], one[chain[:, 0]])
    np.add.at(right, chain[:, 0], one[chain[:, 1]])
    np.add.at(same, skip[:, 1], one[skip[:, 0]])
    np.add.at(same, skip[:, 0], one[skip[:, 1]])
    node, c, s = np.zeros((FEATURES, labels)), np.zeros((labels, labels)), np.zeros((labels, labels))
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (node, c, s)]
    for step in range(1, steps + 1):
        score = x @ node + left @ c + right @ c.T + same @ s
        miss = one - np.exp(score - _lse(score, 1)[:, None])
        grads = [x.T @ miss, left.T @ miss + miss.T @ right, same.T @ miss + miss.T @ same]
        for w, g, (m, v) in zip((node, c, s), grads, state, strict=True):
            g = g / max(1, len(y)) - penalty * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(node, c, s)


def base_spans(lines: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    return sorted((k, at + a, at + b) for at, line in lines for k, find in enumerate(FINDERS) for a, b in find(line))


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Field | None:
    """A field fitted to the base labels of a bounded sample; None without one."""
    t = F.col(text_col)
    rows = docs.filter((F.length(t) <= sample_chars) & t.rlike("[0-9@]")).select(F.xxhash64(F.col(id_col), t).alias("h"), t.alias("t"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.unique(np.concatenate([held, batch.column(0).to_numpy()]))[:sample]
        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["h"])

    # the hashes first, some bytes each; then the texts of those chosen, one for each hash
    chosen = [r["h"] for r in map_arrow(rows.select("h"), least, "h long").distinct().orderBy("h").limit(sample).collect()]
    if not chosen:
        return None
    picked = rows.filter((F.col("h") <= chosen[-1]) & F.col("h").isin(chosen)).groupBy("h").agg(F.min("t").alias("t"))
    graph = Graph()
    for d, row in enumerate(sorted(picked.collect())):
        lines = list(hinted_lines(row["t"]))
        graph.add(d, lines, base_spans(lines), mentions=True)
    return fit_graph(graph) if graph.feats else None


def added_spans(field: Field | None, docs: list[tuple[list[tuple[int, str]], list[tuple[int, int, int]]]], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each document beside its base spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    graph = Graph()
    for d, (lines, base) in enumerate(docs):
        if lines:
            graph.add(d, lines, base)
    if field is None or not graph.feats:
        return out
    prob = field.marginals(graph, known=True)
    label = np.where(prob.max(axis=1) >= SURE, prob.argmax(axis=1), 0)
    linked = set(graph.chain)
    run: list[int] = []

    def close():
        if run and all(graph.labels[n] == 0 for n in run):
            d = graph.doc[run[0]]
            a, b = graph.span[run[0]][0], graph.span[run[-1]][1]
            core = texts[d][a:b]
            a += len(core) - len(core.lstrip(".,;:!?\"'"))
            b -= len(core) - len(core.rstrip(".,;:!?\"'"))
            if a < b and HINT.search(texts[d], a, b):
                out[d].append((int(label[run[0]]) - 1, a, b))
        run.clear()

    for n in np.flatnonzero(label).tolist():
        if run and not (run[-1] == n - 1 and (n - 1, n) in linked and label[n] == label[run[-1]]):
            close()
        run.append(n)
    close()
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


NEW = T.StructType(
    [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("n_added", T.LongType()), T.StructField("base_sha256", T.StringType())]
)


def detect(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs plus base_spans, spans (all), a count of base spans of each kind, n_added and base_sha256."""

    def make():
        def apply(texts):
            found = []
            for t in texts:
                lines = list(hinted_lines(t)) if t else []
                found.append((lines, base_spans(lines)))
            more = added_spans(field, found, texts)
            base = [written(b) for _, b in found]
            cols = {
                "base_spans": pa.array(base, pa.string()),
                "spans": pa.array([written(sorted(b + m)) for (_, b), m in zip(found, more, strict=True)], pa.string()),
                "n_added": pa.array([len(m) for m in more], pa.int64()),
                "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
            }
            for k, name in enumerate(KINDS):
                cols[f"n_{name}"] = pa.array([sum(x[0] == k for x in b) for _, b in found], pa.int64())
            return cols

        return apply

    return append_columns(docs, text_col, NEW, make)


def redact(text: str, spans: str) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    parts, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*parts, text[at:]])
