"""The labels of a line, found inside of its row: what `extract.windows`, `extract.label_matches` and `extract.chosen` find by a
join, for lists of labels that a task can hold. An Arrow function, as likeness has no built-in form.

Windows that a worker has seen before are not compared again. Those new to a batch are held to all labels at once, by lengths
and shared letters; likeness is computed for the pairs that are left.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

#: Labels that a task holds; windows that it remembers, and compares at once.
MOST_LABELS, MOST_SEEN, AT_ONCE = 2000, 200_000, 2048
#: Least likeness of a window to a label by the label's length (longer ones: the last), of each word of a
#: window to its word of a label, and of these words on average.
LIKE_BY_LENGTH, LIKE_LONG, LIKE_WORD, LIKE_WORDS = {1: 0.99, 2: 0.99, 3: 0.99, 4: 0.99, 5: 0.87, 6: 0.83}, 0.85, 0.70, 0.80
#: How far lengths may differ, what a window longer by two or more counts, what word by word and glued hits count.
LENGTH_SLACK, LONGER, BY_WORD, GLUED = 0.34, 0.78, 0.98, 0.95

HIT = "array<struct<start:int,end:int,field:string,alias:string,score:double,weight:double,kind:string,rest:string>>"
_NAMES = ("start", "end", "field", "alias", "score", "weight", "kind", "rest")
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string())
_LOOKALIKES = str.maketrans(*X.LOOKALIKES)
_MARKS = " \t:;,-–—.=~*<>\"'`/\\"
_OTHERS, _SPACES, _DIGIT, _LETTER = re.compile("[^a-z0-9]+"), re.compile(r"[ \t\n\x0b\f\r]{2,}"), re.compile("[0-9]"), re.compile("[A-Za-zऀ-෿]")


def fold(text: str) -> str:
    """As functions.text.fold."""
    low = text.lower().translate(_LOOKALIKES)
    return _OTHERS.sub("", low) if low.isascii() else "".join(c for c in low if unicodedata.category(c)[0] in "LN")


def clean(text: str) -> str:
    """As functions.text.clean."""
    return _SPACES.sub(" ", text.replace("|", " ").replace("_", " ")).strip(_MARKS)


def _has_digit(token: str) -> bool:
    return _DIGIT.search(token) is not None if token.isascii() else any(unicodedata.category(c) == "Nd" for c in token)


def _letters(texts: list[str]) -> np.ndarray:
    """How often each character stands in each text; some fall together, which only weakens the bounds they serve."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % 61
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(rows * 61 + codes, minlength=61 * len(texts)).reshape(-1, 61).astype(np.int16)


def _bits(letters: np.ndarray) -> np.ndarray:
    return ((letters > 0).astype(np.uint64) << np.arange(61, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Search:
    """A list of (field, label, weight) and what is known of windows seen before."""

    def __init__(self, labels: Iterable[tuple[str, str, float]]):
        labels = list(labels)
        self.longest = max((len(label) for _, label, _ in labels), default=0)
        held = [(field, alias, weight, fold(alias), [w for w in map(fold, re.split(r"[ \t\n\x0b\f\r]+", alias)) if w]) for field, alias, weight in labels]
        self.labels = [e for e in held if e[3]]
        self.exact: dict[str, list[int]] = {}
        for i, e in enumerate(self.labels):
            self.exact.setdefault(e[3], []).append(i)
        self.n = np.array([len(e[3]) for e in self.labels], np.int64)
        self.count = np.array([len(e[4]) if len(e[4]) > 1 else 0 for e in self.labels], np.int64)
        self.reach, self.slack = (np.maximum(2, np.floor(self.n * x).astype(np.int64)) for x in (0.9, LENGTH_SLACK))
        self.least = np.array([LIKE_BY_LENGTH.get(len(e[3]), LIKE_LONG) for e in self.labels])
        self.bound = np.where(self.count > 0, np.minimum(LIKE_WORD, self.least), self.least)
        self.letters = _letters([e[3] for e in self.labels])
        self.bits = _bits(self.letters)
        self.matchers = [SequenceMatcher(None, "", e[3]) for e in self.labels]
        self.seen: dict[str, list[tuple[str, str, float, float]]] = {}
        self.folds: dict[str, tuple[str, bool]] = {}
        self.lines: dict[tuple[str, ...], tuple[list[tuple], int]] = {}

    def learn(self, keys: list[str]) -> None:
        """The best label of each field for each window: score * weight, then the longer label."""
        texts = [k.replace(" ", "").removeprefix("+") for k in keys]
        m = np.array([len(t) for t in texts], np.int64)[:, None]
        size = np.array([k.count(" ") + 1 for k in keys], np.int64)[:, None]
        letters = _letters(texts)
        bits = _bits(letters)[:, None]
        apart = np.abs(self.n - m)
        near = apart <= self.slack
        meet = np.where(self.count > 0, (self.count == size) & (apart <= self.reach), near)
        shared = np.minimum(self.n - np.bitwise_count(self.bits & ~bits), m - np.bitwise_count(bits & ~self.bits))
        rows, cols = np.nonzero(meet & (2 * shared >= self.bound * (self.n + m)))
        alike = np.minimum(letters[rows], self.letters[cols]).sum(axis=1)
        fits = 2 * alike >= self.bound[cols] * (self.n[cols] + m[rows, 0])
        found: list[dict[str, tuple]] = [{} for _ in keys]

        def enter(row: int, i: int, score: float) -> None:
            field, alias, weight, label, _ = self.labels[i]
            rank = (score * weight, len(label), score, alias, weight)
            if field not in found[row] or rank > found[row][field]:
                found[row][field] = rank

        for row, text in enumerate(texts):
            for i in self.exact.get(text, ()):
                enter(row, i, 1.0)
        for row, i in zip(rows[fits].tolist(), cols[fits].tolist(), strict=True):
            text, (_, _, _, label, words) = texts[row], self.labels[i]
            if text == label:
                continue
            if near[row, i]:
                self.matchers[i].set_seq1(text)
                like = self.matchers[i].ratio()
                if like >= self.least[i]:
                    enter(row, i, like * (LONGER if len(text) - len(label) >= 2 else 1.0))
            if len(words) > 1:
                likes = [SequenceMatcher(None, a, b).ratio() for a, b in zip(keys[row].split(" "), words, strict=True)]
                total = 0.0
                for x in likes:
                    total += x
                if min(likes) >= LIKE_WORD and total / len(likes) >= LIKE_WORDS:
                    enter(row, i, total / len(likes) * BY_WORD)
        for key, best in zip(keys, found, strict=True):
            self.seen[key] = [(field, alias, score, weight) for field, (_, _, score, alias, weight) in best.items()]

    def folded(self, token: str) -> tuple[str, bool]:
        known = self.folds.get(token)
        if known is None:
            known = self.folds[token] = (fold(token), _has_digit(token))
        return known

    def hits(self, lines: list[list[str]]) -> list[tuple[list[tuple], int]]:
        """For each line's tokens the labels chosen, and how many tokens are but marks."""
        if len(self.seen) > MOST_SEEN:
            self.seen = {}
        if len(self.folds) > MOST_SEEN:
            self.folds = {}
        if len(self.lines) > MOST_SEEN:
            self.lines = {}
        new: dict[str, None] = {}
        plans = []
        for tokens in lines:
            line = tuple(tokens)
            plan = self.lines.get(line) or self._windows(tokens, new)
            plans.append((line, plan))
        keys = list(new)
        if self.labels:
            for at in range(0, len(keys), AT_ONCE):
                self.learn(keys[at : at + AT_ONCE])
        out = []
        for (line, plan), tokens in zip(plans, lines, strict=True):
            if len(plan) == 3:  # not among the lines remembered
                whole, glued, marks = plan
                plan = (self._chosen(tokens, whole, glued) if whole or glued else [], marks)
                if len(tokens) < 8:
                    self.lines[line] = plan
            out.append(plan)
        return out

    def _windows(self, tokens: list[str], new: dict[str, None]) -> tuple[list, list, int]:
        """The places of a line where a label may stand, but for those known to hold none; their texts that are new are noted."""
        folds, seen = [self.folded(t) for t in tokens], self.seen
        whole, glued = [], []
        for j, (text, digit) in enumerate(folds):
            if not text:
                continue
            if not digit:
                key, i = text, j
                while True:
                    if folds[i][0]:
                        known = seen.get(key)
                        if known is None:
                            new[key] = None
                        if known != []:
                            whole.append((i, j + 1, key))
                    i -= 1
                    if i < 0 or i < j - 3:
                        break
                    key = f"{folds[i][0]} {key}"
            if len(text) >= 6 and (digit or ":" in tokens[j]) and _LETTER.search(tokens[j]):
                cuts = []
                for m in range(1, min(len(text) - 1, self.longest + 1) + 1):
                    key = f"+{text[:m]}"
                    known = seen.get(key)
                    if known is None:
                        new[key] = None
                    if known != []:
                        cuts.append((m, key))
                if cuts:
                    glued.append((j, cuts))
        return whole, glued, sum(not text for text, _ in folds)

    def _chosen(self, tokens: list[str], whole: list, glued: list) -> list[tuple]:
        """Hits that do not overlap, the strongest first, in order of their start; glued ones only up to the first that is not,
        and of a token the best."""
        seen, hits = self.seen, []
        for start, end, key in whole:
            for field, alias, score, weight in seen.get(key, ()):
                hits.append((start, end, field, alias, score, weight, "exact" if score == 1.0 else "fuzzy", ""))
        for start, cuts in glued:
            best = None
            for m, key in cuts:
                for field, alias, score, weight in seen.get(key, ()):
                    rank = (score * weight, -m, field)
                    if best is None or rank > best[0]:
                        rest = self._rest(tokens[start], m)
                        if rest:
                            best = rank, (start, start + 1, field, alias, score * GLUED, weight, "glued", rest)
            if best:
                hits.append(best[1])
        if len(hits) < 2:
            return hits
        hits.sort(key=lambda h: (-(h[4] * h[5] + 0.002 * (h[1] - h[0])), h[0], -h[1], h[2], h))
        free: list[tuple] = []
        for h in hits:
            if not any(k[0] < h[1] and h[0] < k[1] for k in free):
                free.append(h)
        real = min((h[0] for h in free if h[6] != "glued"), default=None)
        return sorted(h for h in free if h[6] != "glued" or real is None or h[0] <= real)

    @staticmethod
    def _rest(token: str, m: int) -> str:
        """What follows a token's first m folded characters."""
        for k, c in enumerate(token):
            m -= fold(c) != ""
            if m == 0:
                return clean(token[k + 1 :])
        return ""


_SEARCHES: dict[tuple, Search] = {}


def _arrow_of(found: list[tuple[list[tuple], int]]) -> pa.Array:
    ends = np.cumsum([0, *(len(hits) for hits, _ in found)])
    columns = zip(*(h for hits, _ in found for h in hits), strict=True) if ends[-1] else [()] * len(_NAMES)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_NAMES))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([marks for _, marks in found], pa.int32())], ["hits", "marks"])


def hits_of(tokens: Column, labels: list[tuple[str, str, float]]) -> Column:
    """tokens: array<string>. hits: the labels chosen, as extract.chosen leaves them; marks: tokens without letter or digit."""
    listed = tuple((field, label, float(weight)) for field, label, weight in labels)

    @F.arrow_udf(f"struct<hits:{HIT},marks:int>")
    def found(batch: pa.Array) -> pa.Array:
        search = _SEARCHES.get(listed)
        if search is None:
            _SEARCHES.clear()
            search = _SEARCHES[listed] = Search(listed)
        words, ends = batch.flatten().to_pylist(), batch.offsets.to_numpy() - batch.offsets[0].as_py()
        return _arrow_of(search.hits([words[a:b] for a, b in zip(ends.tolist(), ends.tolist()[1:], strict=False)]))

    return found(tokens)
