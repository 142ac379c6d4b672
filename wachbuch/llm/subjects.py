"""Subject areas of documents.

For each subject an interpolated trigram model of words is trained on the sentences of labelled
documents, and a background model on all of them. Labels are given per document, so sentences are
dealt to subjects in a few rounds: each goes to the subject whose model beats the background most, a
sentence that no subject model explains better (the standing phrases of the press office, which stand
under every subject) goes to none, and the models are trained anew. A document has the subjects that
at least a third of its sentences are about, standing phrases not counted.

A sentence is about each subject whose cross-entropy per token lies far enough below the background's: by ``r + c / n``
nats for a sentence of n tokens, since few tokens prove less. A further subject counts as well if its lead is at least
``CLOSE`` of the best one's. Rate r and evidence c are calibrated on a held-out fifth of the labelled documents: first one pair
for all subjects, then each subject's own, where it does better. The models are fitted on at most ``LABELS`` labelled rows, whose texts are of at most
``LABEL_CHARS`` characters (chosen by hash); every document is judged, whole, with one pass over the corpus.

Defined results: NULL, empty and blank texts, and texts of standing phrases only, have no subject.
Copies are judged each on its own and get the same subjects. Labels of unknown documents or subjects
are ignored; without any usable label no document has a subject.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS, LABEL_CHARS = 20_000, 20_000
ROUNDS = 5
#: Occurrences of a sentence that are left out of the models when it is dealt to one.
ITSELF = 3
#: Part of the weight that a sentence dealt to no subject keeps in those of its documents.
DOUBT = 0.3
SHARE = 1 / 3
#: Weights of trigram, bigram, unigram and of any word at all.
MIX = (0.55, 0.28, 0.14, 0.03)
#: Acceptances that are tried: evidence of a sentence and rate per token, in nats; the first is the one to begin with.
ACCEPT = tuple((c, r) for r in (0.0, 0.02, 0.04) for c in (0.9, 0.3, 0.6, 1.2, 1.6))
#: Part of the best subject's lead that a further subject must have.
CLOSE = 0.8
REMEMBERED = 300_000

_TAG = re.compile(r"<[^<>]{1,200}>")
_HIDDEN = re.compile("[​-‍⁠﻿\xad\x00-\x08\x0e-\x1f️]")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_END = re.compile(r"(?<=[.!?…])[\"“”»)]*\s+|\n\s*\n")
_ORDINAL = re.compile(r"(?:^|\s)\d{1,3}\.$")


def clean(text: str) -> str:
    """Markup, hidden characters, symbols and mangled letters removed or put right."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "Ã" in text or "â€" in text:
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            text = re.sub(r"Ã.", lambda m: _mended(m[0]), text)
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return "".join(c for c in text if unicodedata.category(c) not in ("So", "Sk", "Cs", "Co", "Cn")) if not text.isascii() else text


def _mended(pair: str) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return pair.encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return pair


def sentences(text: str | None) -> list[tuple[str, ...]]:
    """The words of each sentence, numbers as 0. A number with a dot doesn't end a sentence."""
    out: list[tuple[str, ...]] = []
    held = ""
    for part in _END.split(clean(text or "")):
        held = f"{held} {part}".strip() if held else part.strip()
        if _ORDINAL.search(held):
            continue
        ws = tuple("0" if w[0].isdigit() else w for w in _WORD.findall(held.lower()))
        if len(ws) > 1:
            out.append(ws)
        held = ""
    if held and len(ws := tuple("0" if w[0].isdigit() else w for w in _WORD.findall(held.lower()))) > 1:
        out.append(ws)
    return out


class Model:
    """Interpolated trigram model of sentences."""

    def __init__(self, size: int):
        self.size = size
        self.total = 0.0
        self.n1: dict[str, float] = defaultdict(float)
        self.n2: dict[tuple[str, str], float] = defaultdict(float)
        self.n3: dict[tuple[str, str, str], float] = defaultdict(float)
        self.t2: dict[str, float] = defaultdict(float)
        self.t3: dict[tuple[str, str], float] = defaultdict(float)

    def add(self, s: tuple[str, ...], weight: float) -> None:
        a = b = "^"
        for w in (*s, "$"):
            self.total += weight
            self.n1[w] += weight
            self.n2[b, w] += weight
            self.n3[a, b, w] += weight
            self.t2[b] += weight
            self.t3[a, b] += weight
            a, b = b, w

    def log(self, s: tuple[str, ...]) -> float:
        """Log probability of a sentence."""
        x3, x2, x1, x0 = MIX
        out, a, b = 0.0, "^", "^"
        least = 1e-6
        for w in (*s, "$"):
            p = x0 / self.size
            if self.total > least:
                p += x1 * max(0.0, self.n1.get(w, 0.0)) / self.total
                if (m := self.t2.get(b, 0.0)) > least:
                    p += x2 * max(0.0, self.n2.get((b, w), 0.0)) / m
                if (m := self.t3.get((a, b), 0.0)) > least:
                    p += x3 * max(0.0, self.n3.get((a, b, w), 0.0)) / m
            out += math.log(p)
            a, b = b, w
        return out


class Subjects:
    """The subject models, the background and the calibrated thresholds."""

    def __init__(self, data: list[tuple[list[tuple[str, ...]], frozenset[str]]], names: list[str]):
        self.names = names
        self.accept = dict.fromkeys(names, ACCEPT[2])
        self.seen: dict[tuple[str, ...], dict[str, float]] = {}
        held = [d for k, d in enumerate(data) if k % 5 == 4] if len(data) >= 50 else []
        if held:
            self.fit([d for k, d in enumerate(data) if k % 5 != 4])
            self.calibrate(held)
        self.fit(data)

    def calibrate(self, held: list[tuple[list[tuple[str, ...]], frozenset[str]]]) -> None:
        def f1(accept: dict[str, tuple[float, float]]) -> float:
            self.accept = accept
            got = [(set(self.of(ss)), want) for ss, want in held]
            return 2 * sum(len(g & w) for g, w in got) / max(1, sum(len(g) + len(w) for g, w in got))

        # of equally good ones the first
        quality, _, pair = max((f1(dict.fromkeys(self.names, x)), -k, x) for k, x in enumerate(ACCEPT))
        best = dict.fromkeys(self.names, pair)
        for name in self.names:
            own = max((f1(best | {name: x}), -k, x) for k, x in enumerate(ACCEPT))
            # more than one document must be better for it
            if own[0] > quality + 1 / len(held):
                quality, best = own[0], best | {name: own[2]}
        self.quality, self.accept = quality, best

    def fit(self, data: list[tuple[list[tuple[str, ...]], frozenset[str]]]) -> None:
        bag: dict[tuple[tuple[str, ...], frozenset[str]], int] = Counter((s, names) for ss, names in data for s in ss)
        words = {w for s, _ in bag for w in s}
        size = len(words) + 2
        self.background = Model(size)
        distinct: Counter[tuple[str, ...]] = Counter()
        dealt: dict[tuple[str, ...], Counter[str]] = defaultdict(Counter)
        for (s, names), n in sorted(bag.items(), key=lambda x: (x[0][0], sorted(x[0][1]))):
            distinct[s] += n
            for x in names:
                dealt[s][x] += n / len(names)
        labelled = {s: Counter(c) for s, c in dealt.items()}
        self.models = {x: Model(size) for x in self.names}
        for s, n in distinct.items():
            self.background.add(s, n)
            for x, k in dealt[s].items():
                self.models[x].add(s, k)
        for _ in range(ROUNDS):
            self.seen, new = {}, {}
            for s, n in distinct.items():
                # a rare sentence must not vouch for itself, or it stays where it happens to stand
                out = min(n, ITSELF)
                self.background.add(s, -out)
                for x, k in dealt[s].items():
                    self.models[x].add(s, -k * out / n)
                x = max(self.lead(s).items(), key=lambda v: (v[1], v[0]), default=("", -1.0))
                x = x[0] if x[0] and x[1] >= self.least(x[0], s) else None
                self.seen.clear()
                # one that is dealt to none keeps a part of its labels' weight, so that it may return
                new[s] = Counter({x: n} if x else {y: k * DOUBT for y, k in labelled[s].items()})
                self.background.add(s, out)
                for x, k in dealt[s].items():
                    self.models[x].add(s, k * out / n)
            dealt = defaultdict(Counter, new)
            self.models = {x: Model(size) for x in self.names}
            for s in distinct:
                for x, k in dealt[s].items():
                    self.models[x].add(s, k)
        self.seen = {}

    def lead(self, s: tuple[str, ...]) -> dict[str, float]:
        """By how many nats a token each subject's cross-entropy lies below the background's, for those below it."""
        if s not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            base = self.background.log(s)
            self.seen[s] = {x: d for x, m in self.models.items() if (d := (m.log(s) - base) / (len(s) + 1)) > 0}
        return self.seen[s]

    def about(self, s: tuple[str, ...]) -> list[str]:
        """The subjects of a sentence; none if the background explains it as well."""
        got = self.lead(s)
        least = CLOSE * max(got.values(), default=0.0)
        return [x for x, d in got.items() if d >= self.least(x, s) and d >= least]

    def least(self, name: str, s: tuple[str, ...]) -> float:
        """Nats a token from which a sentence is about a subject."""
        c, r = self.accept[name]
        return r + c / (len(s) + 1)

    def of(self, ss: list[tuple[str, ...]]) -> list[str]:
        told = [a for s in ss if (a := self.about(s))]
        n = Counter(x for a in told for x in a)
        return sorted(x for x, k in n.items() if k >= SHARE * len(told) - 1e-9)


def train(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> Subjects:
    names = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "subject").where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).distinct()
    mine = mine.orderBy(F.xxhash64("doc_id"), "subject").limit(LABELS).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    # LABELS rows at most, so this side is small by construction
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= LABEL_CHARS).join(F.broadcast(mine), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return Subjects([(sentences(r["text"]), frozenset(r["subjects"])) for r in rows], names)


def found(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """p10_found: ``doc_id, subject``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, areas))
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = [(i, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in m.of(sentences(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "doc_id long, subject string")
