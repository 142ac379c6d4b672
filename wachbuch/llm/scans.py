"""Repair of text from scanned pages.

Three averaged perceptrons are trained on the corpus itself, without hand-made labels:

* *Furniture*: is a line a running header, a page number or text? Features are its letters and shape
  and where it stands: next to blank lines or form feeds, at the edge of the text, whether its shape recurs
  in the document and in the corpus, whether its number follows the one of the page before. It learns from plain
  cases: a shape that recurs within most of its documents is furniture, a line that ends a sentence or
  never recurs is text, a bare number is a page number. The model decides every line, page numbers too.
* *Characters*: for each character of a word one operation: keep, delete, replace (by one or two characters)
  or insert another behind it. It learns from rare words that are one or two edits away from a
  frequent one, from slips made up after those, and from frequent words, which stay as they are.
* *Line ends*: whether a final hyphen divides a word (join), belongs to it (keep) or ends a part of a
  word that is completed elsewhere (apart).

A word is repaired if an edited form is a word of the corpus and far more frequent than the word
itself. Words torn in two by a blank are put together by the same test. Counts are exact, over the whole
corpus and for rare words too: each distinct word is repaired once, its edited forms are joined to the
table of all counts, and the results are joined back to the documents that need them. Only words with a share of
at least ``SHARE`` (at most 1 / SHARE of them) go to the workers as a list, with the result that the joins
gave for them; that shortens the way and changes no result.

What reaches the driver is bounded: those words, line shapes in at least ``SHAPE_SHARE`` of the documents, and
the samples that the models are fitted on, all drawn by hash: ``RARE`` rare words, ``FREQUENT`` frequent ones,
``DOCS`` documents of at most ``SAMPLE_CHARS`` characters, and of the steps made from them ``CHAR_STEPS``,
``LINE_STEPS`` and ``END_STEPS``.

Defined results: NULL and empty texts give no rows; equal rows come out once; documents of the same
file are repaired each on their own, and so are documents under the same or no id. Very long texts are processed whole,
line by line.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachbuch.llm.perceptron import Perceptron
from wachbuch.session import cut, width

SHARE, SHAPE_SHARE = 1e-5, 3e-4
#: Bounds of the samples that the models are fitted on; see above.
RARE, FREQUENT, STEADY, DOCS, SAMPLE_CHARS = 20_000, 20_000, 1_500, 2_000, 20_000
CHAR_STEPS, LINE_STEPS, END_STEPS = 100_000, 40_000, 40_000
RATIO = 6
#: One misreading of a word makes up at most this share of its correct writings.
VARIANT = 1 / 40
#: Made-up misreadings that the characters' model is also fitted on.
MADE_UP = 6_000
#: Least count of a word that others are repaired to.
LEAST = 4
#: Marks that divide a word at a line's end, and characters that surround words.
MARKS = "-‐\xac\xad"
AROUND = " \t\x0c.,;:!?()[]{}\"'„“”‚‘’«»–—·^…/|*"
BEAM, TRIES = 12, 3
#: Joints after which a part of a word stands alone.
JOINTS = ("und", "oder", "sowie", "bzw", "bis")

#: Words that may stand before a page number.
_ROMAN = r"[ivxl]{1,5}"
_NUMBER = r"(?:\d{1,4}|[lI])"
PAGE_NO = re.compile(rf"^\W*(?:(?:seite|s\.|blatt|bl\.|page|p\.)\s*)?(?:{_NUMBER}|{_ROMAN})(?:\s*(?:von|/|of)\s*{_NUMBER})?\W*$|^\W*\.\.\.\s*/\s*{_NUMBER}\W*$", re.I)
#: Least share of its documents within which a shape recurs if it is furniture, and largest one if it is text.
RECURS, STAYS = 0.45, 0.06

Look = dict[str, tuple[int, str | None]]


def shape(line: str) -> str:
    """A line without what differs from page to page."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", line)).strip().lower()


def bounded(data: list, most: int) -> list:
    """All of it, or as many drawn from it evenly."""
    return data if len(data) <= most else random.Random(17).sample(data, most)


def words_of(line: str) -> list[str]:
    return [w for w in (x.strip(AROUND) for x in line.split()) if w]


# -- furniture ----------------------------------------------------------------------------------


def line_features(lines: list[str], recurs: dict[str, tuple[float, float]]) -> list[list[str] | None]:
    """Features of each line; None for blank ones. ``recurs``: shape -> share of documents, share of these within which it recurs."""
    shapes = [shape(x) for x in lines]
    here = Counter(shapes)
    full = [i for i, s in enumerate(shapes) if s]
    out: list[list[str] | None] = []
    page = 0
    for i, s in enumerate(shapes):
        if not s:
            out.append(None)
            continue
        f = [f"len{min(len(s) // 6, 12)}", f"n{min(here[s], 4)}", "bias"]
        share, again = recurs.get(s, (0.0, 0.0))
        f.append("corpus" + ("0" if not share else "1" if again < STAYS else "2" if again < RECURS else "3"))
        f += ["blank<"] * (i > 0 and not shapes[i - 1]) + ["blank>"] * (i + 1 < len(shapes) and not shapes[i + 1])
        f += ["first"] * (i == full[0]) + ["second"] * (len(full) > 1 and i == full[1]) + ["last"] * (i == full[-1]) + ["last2"] * (len(full) > 1 and i == full[-2])
        f += ["feed"] * ("\x0c" in lines[i]) + ["feed<"] * (i > 0 and "\x0c" in lines[i - 1]) + ["feed>"] * (i + 1 < len(lines) and "\x0c" in lines[i + 1])
        f += ["indent"] * (lines[i][:1] in " \t") + ["wide"] * ("   " in lines[i].strip())
        letters = re.sub(r"[^a-zäöüß]", "", s)
        f.append(f"letters{min(len(letters), 9)}")
        f.append(f"ends{'a' if s[-1].isalpha() else '9' if s[-1] == '9' else s[-1]}")
        f.append(f"starts{'a' if s[0].isalpha() else '9' if s[0] == '9' else s[0]}")
        long = len(s) > 45 and len(s.split()) > 5
        f.append("body" if long else "short")
        if not long:
            if PAGE_NO.match(s) and len(s) < 18:
                f.append("bare")
                if m := re.search(r"\d{1,4}", lines[i]):
                    f.append("next" if int(m[0]) == page + 1 else "nonext")
                    page = int(m[0])
            # letters only tell of short lines; long ones are known by length and words
            f += [f"g{s[k : k + 3]}" for k in range(min(len(s) - 2, 40))]
        f += ["w" + w.strip("·–-.,()[]") for w in s.split()[:6]]
        f.append("pat" + re.sub(r"[a-zäöüß]+", "a", s)[:16])
        out.append(f)
    return out


def shape_labels(recurs: dict[str, tuple[float, float]]) -> dict[str, str]:
    """What the shapes known from the corpus plainly are: those that recur within their documents are headers, and so are
    misread writings of these; those that stay alone and look unlike any header are text."""
    grams = lambda s: {s[k : k + 3] for k in range(len(s) - 2)}
    open_ = {s: v[1] for s, v in recurs.items() if not _bare(s) and not _told(s)}
    heads = [g for s, again in open_.items() if again >= RECURS and (g := grams(s))]
    out = {}
    for s, again in open_.items():
        g = grams(s)
        like = max((len(g & h) / max(len(g), len(h)) for h in heads if 0.5 < len(g) / len(h) < 2), default=0.0) if g else 0.0
        if like >= 0.6 or again >= RECURS:
            out[s] = "header"
        elif like < 0.35 and again < STAYS:
            out[s] = "text"
    return out


def _bare(s: str) -> bool:
    return len(s) < 18 and PAGE_NO.match(s) is not None


def _told(s: str) -> bool:
    """Whether a line's end or length tells that it is text."""
    return s.endswith((".", ";", ",")) or len(s) > 60 or (len(s) > 45 and len(s.split()) > 5)


def plain_label(s: str, labels: dict[str, str]) -> str | None:
    """What a line of this shape plainly is; None if that is open."""
    return "page_no" if _bare(s) else "text" if _told(s) else labels.get(s)


# -- characters ---------------------------------------------------------------------------------


def char_features(w: str, i: int, before: str) -> list[str]:
    p = f"^^{w}$$"
    a, b, c, d, e = p[i : i + 5]
    return [f"c{c}", f"l{b}{c}", f"r{c}{d}", f"m{b}{c}{d}", f"L{a}{b}{c}", f"R{c}{d}{e}", f"o{before}{c}", f"x{'1' if w[i].isdigit() else 'u' if w[i].isupper() else 'a'}{'1' if b.isdigit() else 'u' if b.isupper() else 'a'}{c}", f"p{min(i, 2)}{c}"]


def operations(noisy: str, clean: str) -> list[str] | None:
    """Cheapest operation of each character of ``noisy`` that yields ``clean``: K, D, R with its new characters, or I
    with the character that is missing behind it."""
    n, m = len(noisy), len(clean)
    inf = 99.0
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    back: dict[tuple[int, int], tuple[int, str]] = {}
    cost[0][0] = 0.0
    for i in range(n):
        for j in range(m + 1):
            here = cost[i][j]
            if here >= inf:
                continue
            steps = [(0, 1.0, "D")]
            if j < m:
                steps.append((1, 0.0, "K") if noisy[i] == clean[j] else (1, 1.0, "R" + clean[j]))
            if j + 1 < m:
                steps.append((2, 1.0, "I" + clean[j + 1]) if noisy[i] == clean[j] else (2, 1.6, "R" + clean[j : j + 2]))
            for dj, x, op in steps:
                if here + x < cost[i + 1][j + dj]:
                    cost[i + 1][j + dj] = here + x
                    back[i + 1, j + dj] = (j, op)
    if cost[n][m] >= inf:
        return None
    out, j = [], m
    for i in range(n, 0, -1):
        j, op = back[i, j]
        out.append(op)
    return out[::-1]


def applied(c: str, op: str) -> str:
    """What an operation makes of a character."""
    return {"K": c, "D": "", "I": c + op[1:], "R": op[1:]}[op[0]]


def candidates(w: str, model: Perceptron) -> list[tuple[float, str]]:
    """Edited forms of a word, best first."""
    beam: list[tuple[float, str, str]] = [(0.0, "", "K")]
    for i in range(len(w)):
        new = []
        for score, text, before in beam:
            s = model.scores(char_features(w, i, before[0]))
            keep = s.get("K", 0.0)
            options = sorted(((v, op) for op, v in s.items()), reverse=True)[:TRIES]
            if not any(op == "K" for _, op in options):
                options.append((keep, "K"))
            for v, op in options:
                new.append((score + v, text + applied(w[i], op), op))
        new.sort(key=lambda x: -x[0])
        seen: set[tuple[str, str]] = set()
        beam = []
        for x in new:
            if (x[1], x[2]) not in seen:
                seen.add((x[1], x[2]))
                beam.append(x)
            if len(beam) == BEAM:
                break
    return [(s, t) for s, t, _ in beam]


def deletions(w: str, k: int) -> set[str]:
    return {"".join(c for i, c in enumerate(w) if i not in out) for n in range(k + 1) for out in combinations(range(len(w)), n)}


def mined_pairs(counts: dict[str, int], rare: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """(misread, printed) for rare words with one clearly most frequent neighbour."""
    lexicon = [w for w, n in sorted(counts.items(), key=lambda x: -x[1])[:FREQUENT] if 4 <= len(w) <= 16 and w.isalpha()]
    index: dict[str, list[str]] = defaultdict(list)
    for w in lexicon:
        for d in deletions(w, 2):
            index[d].append(w)
    out = []
    for w, n in rare:
        if not 4 <= len(w) <= 18 or w.isdigit():
            continue
        near = {v for d in deletions(w, 2) for v in index.get(d, ())}
        good = []
        for v in near:
            ops = operations(w, v)
            changed = sum(op != "K" for op in ops) if ops else 9
            if v != w and changed <= 2 and counts[v] >= RATIO * n:
                good.append((changed, -counts[v], v))
        if good:
            good.sort()
            if len(good) == 1 or good[0][0] < good[1][0] or good[0][1] * 1.0 <= 4 * good[1][1]:
                out.append((w, good[0][2]))
    return out


def made_up(pairs: list[tuple[str, str]], words: list[tuple[str, int]], seed: int = 11) -> list[tuple[str, list[str]]]:
    """Misreadings with one to three of the slips seen in the mined pairs, with their operations."""
    slips: Counter[tuple[str, str]] = Counter()
    for noisy, clean in pairs:
        run, ops = "", operations(noisy, clean) or []
        new = ""
        for c, op in [*zip(noisy, ops, strict=False), ("", "K")]:
            if op == "K":
                if run:
                    slips[run, new] += 1
                run = new = ""
            elif op[0] == "I":
                slips[run + c, new + c + op[1:]] += 1
                run = new = ""
            else:
                run, new = run + c, new + op[1:]
    common = [(k, n) for k, n in slips.most_common(150) if n > 1 and len(k[0]) <= 2]
    by_clean: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for (noisy, clean), n in common:
        by_clean[clean].append((noisy, n))
    pick = random.Random(seed)
    long_words = [w for w, _ in words if len(w) > 3]
    out: list[tuple[str, list[str]]] = []
    for _ in range(MADE_UP if long_words and by_clean else 0):
        clean = pick.choice(long_words)
        at, text, ops = 0, "", []
        budget = pick.choice((1, 1, 2, 3))
        while at < len(clean):
            options = [(c, k) for k in (2, 1) for c in by_clean.get(clean[at : at + k], ()) if len(clean[at : at + k]) == k]
            if options and budget and pick.random() < budget / max(2, len(clean) - at):
                (noisy, _), k = pick.choices(options, weights=[c[1] for c, _ in options])[0]
                text += noisy
                good = clean[at : at + k]
                ops += ["I" + good[1] if noisy == good[0] and k == 2 else "R" + good, *["D"] * (len(noisy) - 1)]
                at += k
                budget -= 1
                continue
            if "" in by_clean and budget and at and pick.random() < 0.04:
                noisy = pick.choices([c[0] for c in by_clean[""]], weights=[c[1] for c in by_clean[""]])[0]
                text += noisy
                ops += ["D"] * len(noisy)
                budget -= 1
            text += clean[at]
            ops.append("K")
            at += 1
        if text != clean:
            out.append((text, ops))
    return out


# -- the whole model ----------------------------------------------------------------------------


class Repairer:
    """The three models with the frequent words; applied to one text at a time.

    ``common``: the frequent words with their counts and, once ``settle`` gave them, their repairs. What isn't frequent
    comes with each text: ``look`` maps the words that ``needs`` named to their counts and repairs.
    """

    def __init__(self, common: dict[str, int], rare: list[tuple[str, int]], recurs: dict[str, tuple[float, float]], sample: list[str]):
        self.common: Look = {w: (n, None) for w, n in common.items()}
        self.recurs = recurs
        pairs = mined_pairs(common, rare)
        noisy = {w for w, _ in pairs}
        steady = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if w not in noisy and w.isalpha()][:STEADY]
        self.chars = Perceptron().fit(bounded(self.steps(pairs, steady), CHAR_STEPS), 4)
        labels = shape_labels(recurs)
        lines_data: list[tuple[list[str], str]] = []
        for text in sample:
            lines = text.split("\n")
            for line, f in zip(lines, line_features(lines, recurs), strict=True):
                if f is not None and (y := plain_label(shape(line), labels)):
                    lines_data.append((f, y))
        self.lines = Perceptron().fit(bounded(lines_data, LINE_STEPS), 4)
        self.ends = Perceptron()

    @staticmethod
    def steps(pairs: list[tuple[str, str]], steady: list[str]) -> list[tuple[list[str], str]]:
        """Single decisions on characters, from mined and made-up misreadings and from words that stay."""
        data = [(char_features(w, i, "K"), "K") for w in steady for i in range(len(w))]
        for w, ops in [*((w, operations(w, v) or []) for w, v in pairs), *made_up(pairs, [(x, 1) for x in steady])]:
            for i, (op, before) in enumerate(zip(ops, ["K", *ops], strict=False)):
                data.append((char_features(w, i, before[0]), op))
        return data

    def fit_ends(self, sample: list[tuple[list[str], list[str]]], look: Look) -> Repairer:
        """The line ends' model, from divided words that are written undivided elsewhere."""
        ends: list[tuple[list[str], str]] = []
        for lines, kinds in sample:
            for _, w1, mark, w2 in self.divided(lines, kinds):
                whole, kept, alone = (self.count(x, look) for x in (w1 + w2, f"{w1}-{w2}", w1 + "-"))
                y = "keep" if kept > whole else "join" if whole >= LEAST and whole > alone / 50 else "apart" if w2 in JOINTS and alone else None
                if y:
                    ends.append((self.end_features(w1, mark, w2, look), y))
        self.ends.fit(bounded(ends, END_STEPS), 4)
        return self

    def settle(self, repairs: dict[str, str]) -> Repairer:
        self.common = {w: (n, repairs.get(w)) for w, (n, _) in self.common.items()}
        return self

    def count(self, w: str, look: Look) -> int:
        return (self.common.get(w) or look.get(w) or (0,))[0]

    def repaired(self, w: str, look: Look) -> str | None:
        """The word as printed, or None if it isn't taken for a misreading."""
        return (self.common.get(w) or look.get(w) or (0, None))[1]

    def kinds(self, lines: list[str]) -> list[str]:
        """header, page_no, text or blank, for each line."""
        return ["blank" if f is None else self.lines.best(f, "text") for f in line_features(lines, self.recurs)]

    def divided(self, lines: list[str], kinds: list[str]) -> Iterator[tuple[int, str, str, str]]:
        """(line, first part, mark, second part) of line ends with a mark of division."""
        text = [i for i, k in enumerate(kinds) if k == "text"]
        for i, j in zip(text, text[1:], strict=False):
            end = lines[i].rstrip(" \t\r\x0c")
            if end and end[-1] in MARKS and end[-2:-1].isalnum():
                parts = words_of(lines[j])
                first = end[:-1].split()[-1].lstrip(AROUND)
                if parts and first:
                    yield i, first, end[-1], parts[0]

    def end_features(self, w1: str, mark: str, w2: str, look: Look) -> list[str]:
        few = lambda w: min(3, self.count(w, look))
        return [
            "bias", f"mark{mark}", f"low{w2[:1].islower()}", f"num{w1[-1:].isdigit()}", f"joint{w2 in JOINTS}",
            f"whole{few(self.repaired(w1 + w2, look) or w1 + w2)}", f"kept{few(f'{w1}-{w2}')}", f"alone{few(w1 + '-')}",
            f"second{few(w2)}", f"mark{mark}low{w2[:1].islower()}joint{w2 in JOINTS}",
        ]

    def needs(self, lines: list[str], kinds: list[str]) -> tuple[set[str], set[str]]:
        """The words that aren't frequent whose counts and whose repairs ``rows`` will look at."""
        asked: set[str] = set()
        out: set[str] = set()
        for _, w1, _, w2 in self.divided(lines, kinds):
            out.update((w1 + "-", w1, w2))
            asked.update((w1 + w2, f"{w1}-{w2}"))
        for line, kind in zip(lines, kinds, strict=True):
            if kind == "text":
                last = ""
                for w in words_of(line):
                    out.add(w)
                    asked.add(stem(w))
                    # two frequent words are parts of a torn one only if that is frequent too
                    if last and w.islower() and (w not in self.common or last not in self.common):
                        out.add(last + w)
                    last = w
        asked = {w for w in asked if w not in self.common}
        return asked | {w for w in out if w not in self.common}, asked

    def torn(self, a: str, b: str, look: Look) -> str | None:
        """The word that two neighbours are the parts of, if one of them hardly ever stands alone."""
        n = self.count(a + b, look)
        if n and outweighs(n, min(self.count(a, look), self.count(b, look))) and a[-1].isalpha() and b.isalpha() and b.islower():
            return a + b
        return None

    def rows(self, lines: list[str], kinds: list[str], look: Look) -> set[tuple[int, str, str]]:
        """(line_no, kind, fixed), lines counted from 1."""
        out: set[tuple[int, str, str]] = {(i + 1, k, "") for i, k in enumerate(kinds) if k in ("header", "page_no")}
        text_lines = [i for i, k in enumerate(kinds) if k == "text"]
        follows = dict(zip(text_lines, text_lines[1:], strict=False))
        taken: set[int] = set()
        for i, w1, mark, w2 in self.divided(lines, kinds):
            y = self.ends.best(self.end_features(w1, mark, w2, look), "join")
            if y == "apart":
                continue
            whole = w1 + ("-" if y == "keep" else "") + w2
            fixed = self.repaired(whole, look)
            out.add((i + 1, "hyphen", fixed or whole))
            if fixed:
                out.add((i + 1, "ocr", fixed))
            taken.add(i)
        begun = {follows[i] for i in taken}
        for i in text_lines:
            ws = words_of(lines[i])
            ws = ws[1:] if i in begun else ws
            ws = ws[:-1] if i in taken else ws
            k = 0
            while k < len(ws):
                w = ws[k]
                if k + 1 < len(ws) and (v := self.torn(w, ws[k + 1], look)):
                    out.add((i + 1, "ocr", v))
                    k += 2
                    continue
                k += 1
                if v := self.repaired(stem(w), look):
                    out.add((i + 1, "ocr", v + ("-" if stem(w) != w else "")))
        return out

    def paragraphs(self, lines: list[str], kinds: list[str], look: Look) -> str:
        """The text as continuous paragraphs: no furniture, words whole and as printed."""
        paras: list[list[str]] = [[]]
        glue = False
        ends = {i: self.ends.best(self.end_features(w1, m, w2, look), "join") for i, w1, m, w2 in self.divided(lines, kinds)}
        for i, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
            if kind in ("header", "page_no"):
                continue
            if kind == "blank":
                # a blank line ends a paragraph only where a sentence ended
                if paras[-1] and not glue and paras[-1][-1][-1:] not in "abcdefghijklmnopqrstuvwxyzäöüß,-":
                    paras.append([])
                continue
            tokens = line.replace("\x0c", "").split()
            if glue and tokens and paras[-1]:
                paras[-1][-1] += tokens.pop(0)
                glue = False
            paras[-1] += tokens
            if ends.get(i, "apart") != "apart":
                glue = True
                if ends[i] == "join":
                    paras[-1][-1] = paras[-1][-1].rstrip(MARKS)
        return "\n\n".join(" ".join(self.in_place(w, look) for w in p) for p in paras if p)

    def in_place(self, token: str, look: Look) -> str:
        core = stem(token.strip(AROUND))
        v = self.repaired(core, look) if core else None
        return token.replace(core, v) if v else token


def stem(w: str) -> str:
    """A word without a hyphen behind it."""
    return w.rstrip(MARKS) or w if w[-1:] in MARKS else w


def outweighs(n: int, own: int) -> bool:
    """Whether a word written n times can be what a word written ``own`` times was misread from."""
    return n >= max(LEAST, RATIO * own) and own <= max(3, n * VARIANT)


# -- counts and joins ---------------------------------------------------------------------------


def vocabulary(texts: DataFrame) -> DataFrame:
    """``w, n``: how often each word is written in all texts; ``#word``: how often it stands behind a number and hyphen."""
    around = "[" + "".join(re.escape(c) for c in AROUND) + "]+"
    tokens = texts.select(F.explode(F.split("text", r"[\s\p{Z}]+")).alias("t"))
    w = tokens.select(F.regexp_replace("t", f"^{around}|{around}$", "").alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    numbered = w.where(F.col("w").rlike(r"^\d{1,3}-\D")).groupBy(F.concat(F.lit("#"), F.regexp_extract("w", r"^\d{1,3}-(.*)$", 1)).alias("w")).agg(F.sum("n").alias("n"))
    return w.unionByName(numbered)


def recurring(texts: DataFrame) -> dict[str, tuple[float, float]]:
    """shape -> share of the documents that have it, share of these within which it recurs; for shapes with a share of
    at least ``SHAPE_SHARE``, and 3 documents."""
    n_docs = texts.count()
    s = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col("line"), r"\d+", "9"), r"\s+", " ")))
    lines = texts.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(F.split("text", "\n")).alias("line")).select("row", s.alias("s")).where(F.length("s").between(1, 70))
    per_doc = lines.groupBy("row", "s").agg(F.count("*").alias("k"))
    got = per_doc.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("again")).where(F.col("n") >= max(3, int(SHAPE_SHARE * n_docs)))
    return {r["s"]: (r["n"] / n_docs, r["again"] / r["n"]) for r in got.collect()}


def train(docs: DataFrame, vocab: DataFrame, text_col: str = "text") -> Repairer:
    """The models, fitted on bounded samples; ``vocab``: see ``vocabulary``."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''")
    recurs = recurring(texts)
    plain = vocab.where("w not like '#%'")
    total = plain.agg(F.sum("n")).first()[0] or 0
    common = {r["w"]: r["n"] for r in vocab.where(F.col("n") >= max(LEAST, SHARE * total)).collect()}
    rare = [(r["w"], r["n"]) for r in plain.where((F.col("n") < max(LEAST, 0.0005 * total)) & (F.length("w") >= 4)).orderBy(F.xxhash64("w")).limit(RARE).collect()]
    sample = [r["text"] for r in texts.where(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("text")).limit(DOCS).collect()]
    model = Repairer(common, rare, recurs, sample)
    read = [(lines, model.kinds(lines)) for lines in (t.split("\n") for t in sample)]
    asked = {w for lines, kinds in read for w in model.needs(lines, kinds)[0]}
    spark = docs.sparkSession
    # as bounded as the sample
    look = {r["w"]: (r["n"], None) for r in vocab.join(spark.createDataFrame([(w,) for w in sorted(asked)], "w string"), "w").collect()} if asked else {}
    return model.fit_ends(read, look)


def repairs(asked: DataFrame, vocab: DataFrame, chars: Perceptron) -> DataFrame:
    """``w, fixed``: the distinct words ``asked`` (``w``) that are misread. Each edited form is joined to its exact count."""
    shared = asked.sparkSession.sparkContext.broadcast(chars)
    schema = pa.schema([("w", pa.string()), ("form", pa.string()), ("key", pa.string()), ("score", pa.float64())])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w in b.column(0).to_pylist():
                if sum(c.isalpha() for c in w) < 2 or w[-1] in MARKS:
                    continue
                # a part behind a number and hyphen is repaired on its own, and counted with every number
                m = re.fullmatch(r"(\d{1,3}-)(\D.*)", w)
                head, rest = (m[1], m[2]) if m else ("", w)
                for score, v in candidates(rest, shared.value):
                    if v and v != rest:
                        rows += [(w, head + v, k, score) for k in ((v, "#" + v) if head else (v,))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    # few bytes but much work a word, so their number of parts is fixed
    forms = asked.select("w").repartition(4 * width(asked.sparkSession), "w").mapInArrow(propose, "w string, form string, key string, score double")
    known = forms.join(vocab.where(F.col("n") >= LEAST).select(F.col("w").alias("key"), "n"), "key").groupBy("w", "form").agg(F.max("n").alias("n"), F.max("score").alias("score"))
    # a word that mostly stands with a hyphen behind it (first of two joined words) is a word all the same
    own = vocab.select(F.regexp_replace("w", "-$", "").alias("w"), F.col("n").alias("own")).where("w <> ''").groupBy("w").agg(F.sum("own").alias("own"))
    judged = known.join(own, "w", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    judged = judged.where((F.col("n") >= F.greatest(F.lit(LEAST), RATIO * F.col("own"))) & (F.col("own") <= F.greatest(F.lit(3), F.col("n") * VARIANT)))
    best = cut(judged.groupBy("w").agg(F.max(F.struct("score", "form")).alias("b")).select("w", F.col("b.form").alias("fixed")))
    # a frequent misreading leads on to what it is a misreading of
    for _ in range(2):
        onward = best.select(F.col("w").alias("fixed"), F.col("fixed").alias("next"))
        best = best.join(onward, "fixed", "left").select("w", F.coalesce(F.nullif("next", F.col("w")), F.col("fixed")).alias("fixed"))
    return best


def _prepared(docs: DataFrame) -> tuple[Repairer, DataFrame]:
    """The trained model with the repairs of frequent words, and of each document: ``row, court_doc_id, text, kinds, look``."""
    spark = docs.sparkSession
    d = docs.select(F.col("court_doc_id").cast("long").alias("court_doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    vocab = cut(vocabulary(d))
    model = train(d, vocab)
    first = spark.sparkContext.broadcast(model)
    schema = pa.schema([("court_doc_id", pa.int64()), ("text", pa.string()), ("kinds", pa.list_(pa.string())), ("needs", pa.list_(pa.string())), ("asked", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, needs, asked = [], [], []
            for t in b.column(1).to_pylist():
                lines = t.split("\n")
                kinds.append(first.value.kinds(lines))
                n, a = first.value.needs(lines, kinds[-1])
                needs.append(sorted(n))
                asked.append(sorted(a))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.list_(pa.string())) for x in (kinds, needs, asked)]], schema=schema)

    # numbered before the cut, so that a lost executor can't renumber
    texts = cut(d.mapInArrow(read, "court_doc_id long, text string, kinds array<string>, needs array<string>, asked array<string>").withColumn("row", F.monotonically_increasing_id()))
    wanted = texts.select("row", F.explode("needs").alias("w"))
    common = spark.createDataFrame([(w,) for w in sorted(model.common) if w[0] != "#"], "w string")
    fixed = cut(repairs(texts.select(F.explode("asked").alias("w")).unionByName(common).distinct(), vocab, model.chars))
    model.settle({r["w"]: r["fixed"] for r in fixed.join(common, "w", "left_semi").collect()})
    known = vocab.join(fixed, "w", "full").where("w not like '#%'").select("w", F.coalesce("n", F.lit(0)).alias("n"), "fixed")
    look = wanted.join(known, "w").groupBy("row").agg(F.collect_list(F.struct("w", "n", "fixed")).alias("look"))
    return model, texts.drop("needs", "asked").join(look, "row", "left")


def _apply(docs: DataFrame, work: Callable[[Repairer, list[str], list[str], Look], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    model, texts = _prepared(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, kinds, look in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows += [(i, *r) for r in work(shared.value, t.split("\n"), kinds, {x["w"]: (x["n"], x["fixed"]) for x in look or ()})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return texts.select("court_doc_id", "text", "kinds", "look").mapInArrow(run, ddl)


def found(docs: DataFrame) -> DataFrame:
    """p3_found: ``court_doc_id, line_no, kind, fixed``."""
    schema = pa.schema([("court_doc_id", pa.int64()), ("line_no", pa.int64()), ("kind", pa.string()), ("fixed", pa.string())])
    return _apply(docs, lambda m, lines, kinds, look: sorted(m.rows(lines, kinds, look)), schema, "court_doc_id long, line_no long, kind string, fixed string")


def repaired(docs: DataFrame) -> DataFrame:
    """``court_doc_id, text``: each text as continuous paragraphs; NULL and empty texts stay as they are."""
    schema = pa.schema([("court_doc_id", pa.int64()), ("text", pa.string())])
    whole = _apply(docs, lambda m, lines, kinds, look: [(m.paragraphs(lines, kinds, look),)], schema, "court_doc_id long, text string")
    return whole.unionByName(docs.select(F.col("court_doc_id").cast("long").alias("court_doc_id"), F.col("text").cast("string").alias("text")).where("text is null or text = ''"))
