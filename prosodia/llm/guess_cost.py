"""Secrets in texts: fixed patterns, and password guess costs for values beside credential words.

A value is cut into spans of least total cost by dynamic programming. A span is a word of the corpus
(its rank by frequency, times variants of case and of letters written as digits), a date, a repeat, a
keyboard walk, or brute force by character class. The cost is the decimal logarithm of the guesses that an attacker
needs who tries likely things first; a value that costs ``LEAST`` or more is a secret. The words
come from one exact count over all documents; the frequent ones travel as a table of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import frequent_words, letters_table, pieces, rolling, text_bytes, word_counts
from prosodia.llm.shared import _BYTE as BYTE_VALUES

#: Words in the table at most, their lengths in bytes, and the cost from which a value is a secret.
WORDS, SHORTEST, LONGEST, LEAST = 32_768, 3, 24, 10.0

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "guess")

#: A credential word, a separator and a value up to white space, quotes or brackets.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|auth|private|secret|client)[-_\x20]?(?:key|secret|token)|credentials?|authorization|bearer|login)s?["'`]?\x20*(?::=|=>|[:=])\x20*["'`]?([^\s"'`<>(){}]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")

# The keys of an American keyboard by row, each row's shift to the right, and their shifted signs.
ROWS = (("`1234567890-=", 0.0), ("qwertyuiop[]\\", 1.5), ("asdfghjkl;'", 1.75), ("zxcvbnm,./", 2.25))
SHIFTED = dict(zip("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./", strict=True))
# Digits and signs that stand for letters.
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

#: What choosing the kind of a span costs, words apart.
SPAN = math.log10(5)
#: Days of a year, and years that people use.
_DAY, _YEAR = math.log10(366), math.log10(120)
_DATES = (
    (re.compile(r"(?=((?:19|20)\d\d([-/._])(?:0?[1-9]|1[0-2])\2(?:0?[1-9]|[12]\d|3[01])))"), _DAY + _YEAR + math.log10(4)),
    (re.compile(r"(?=((?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d))"), _DAY + _YEAR + math.log10(4)),
    (re.compile(r"(?=((?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])))"), _DAY + _YEAR),
    (re.compile(r"(?=((?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d))"), _DAY + _YEAR),
    (re.compile(r"(?=((?:19|20)\d\d))"), _YEAR),
)
_KEYS = {c: (r, x + shift) for r, (row, shift) in enumerate(ROWS) for x, c in enumerate(row)}
_KEYS |= {s: _KEYS[c] for s, c in SHIFTED.items()}


def brute_costs(value: str) -> list[float]:
    """What a character costs that nothing explains."""

    def one(c: str) -> float:
        if c.isascii():
            return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)
        return 2.0

    return [one(c) for c in value]


class Lexicon:
    """Frequent words by fingerprint, with the cost of each: the logarithm of its rank."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.lexsort((words, -counts))
        cost = np.log10(np.arange(len(words)) + 2.0)
        by_word = np.argsort(words[order], kind="stable")
        self.words, self.cost = words[order][by_word], cost[by_word]

    def found(self, text: str) -> dict[tuple[int, int], float]:
        """(start, end) -> cost of every run of ``SHORTEST`` to ``LONGEST`` bytes that is a word; places are characters."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        place = np.cumsum((raw & 0xC0) != 0x80) - 1
        place = np.append(place, len(text))
        out: dict[tuple[int, int], float] = {}
        if not len(self.words):
            return out
        values = BYTE_VALUES[raw]
        for n in range(SHORTEST, min(LONGEST, len(raw)) + 1):
            names = rolling(values, n)
            at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
            for s in np.flatnonzero(self.words[at] == names).tolist():
                out[int(place[s]), int(place[s + n])] = float(self.cost[at[s]])
        return out


def word_spans(value: str, lexicon: Lexicon) -> Iterator[tuple[int, int, float]]:
    """Words of the value, whatever their case, and words with digits or signs for letters."""
    low = "".join(c.lower() if c.isascii() else c for c in value)
    upper = np.cumsum([0, *(c.isascii() and c.isupper() for c in value)])
    plain = lexicon.found(low)
    turned = "".join(LEET.get(c, c) for c in low)
    leet = np.cumsum([0, *(a != b for a, b in zip(low, turned, strict=True))])
    both = {k: (c, 0) for k, c in plain.items()}
    if turned != low:
        for (a, b), c in lexicon.found(turned).items():
            if (n := int(leet[b] - leet[a])) and (a, b) not in both:
                both[a, b] = c, n
    for (a, b), (cost, signs) in both.items():
        big = int(upper[b] - upper[a])
        if big:
            usual = big == b - a or (big == 1 and upper[a + 1] > upper[a])
            cost += math.log10(2) if usual else math.log10(max(2, math.comb(b - a, min(big, b - a - big))))
        yield a, b, cost + signs * math.log10(2)


def walk_spans(value: str) -> Iterator[tuple[int, int, float]]:
    """Longest runs of four or more keys, each next to the one before; turns cost."""
    keys = [_KEYS.get(c.lower()) for c in value]
    start, turns, way = 0, 0, None

    def done(end: int) -> Iterator[tuple[int, int, float]]:
        if end - start >= 4:
            yield start, end, math.log10(len(_KEYS)) + math.log10(end - start) + turns * math.log10(5)

    for i in range(1, len(keys) + 1):
        step = None
        if i < len(keys) and keys[i] and keys[i - 1]:
            down, right = keys[i][0] - keys[i - 1][0], keys[i][1] - keys[i - 1][1]
            if abs(down) <= 1 and abs(right) <= 1 and (down or right):
                step = (down, right > 0)
        if step is None:
            yield from done(i)
            start, turns, way = i, 0, None
        else:
            turns += way is not None and step != way
            way = step


def repeat_spans(value: str, brute: list[float], words: dict[tuple[int, int], float]) -> Iterator[tuple[int, int, float]]:
    """Longest runs of a repeated unit of one to eight characters: the unit, and how often."""
    codes = np.array([ord(c) for c in value])
    upto = np.concatenate([[0.0], np.cumsum(brute)])
    for p in range(1, min(8, len(value) // 2) + 1):
        same = np.concatenate([[False], codes[p:] == codes[:-p], [False]])
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            times = (b - a + p) // p
            if times >= 2 and times * p >= 3:
                unit = min(float(upto[a + p] - upto[a]), words.get((a, a + p), math.inf))
                yield a, a + times * p, unit + math.log10(times)


def spans_of(value: str, lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """Everything but brute force that may explain a part of the value: (start, end, cost)."""
    words = list(word_spans(value, lexicon))
    own = {(a, b): c for a, b, c in words}
    found = [*words, *walk_spans(value), *repeat_spans(value, brute_costs(value), own)]
    for pattern, cost in _DATES:
        found += [(m.start(1), m.end(1), cost) for m in pattern.finditer(value)]
    return found


def guesses(value: str, lexicon: Lexicon) -> float:
    """log10 of the guesses of the cheapest segmentation; one pass over the value and its spans."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for a, b, c in spans_of(value, lexicon):
        by_end.setdefault(b, []).append((a, c))
    best, brute = [0.0], math.inf
    for i, c in enumerate(brute_costs(value), start=1):
        brute = min(brute, best[-1] + SPAN) + c
        best.append(min([brute, *(best[a] + SPAN + x for a, x in by_end.get(i, ()))]))
    return best[-1]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def scan(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, all spans (start, kind, end) in order, and the greatest cost of a value beside a credential word."""
    low = text.lower()
    base = sorted(base_spans(text, low))
    added, most = [], 0.0
    if any(h in low for h in _HINTS):
        for m in CONTEXT.finditer(text):
            start, end = m.start(1), m.end(1)
            while end > start and text[end - 1] in ".,;:!?]":
                end -= 1
            if end - start < LEAST_ASSIGN:
                continue
            cost = guesses(text[start:end], lexicon)
            most = max(most, cost)
            if cost >= LEAST and not any(a <= start and end <= b for a, _, b in base):
                added.append((start, 3, end))
    return base, sorted([*base, *added]), most


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def lexicon(docs: DataFrame, most: int = WORDS) -> Lexicon:
    """Frequent words of letters (A-Z lower-cased, and whatever isn't ASCII) of all texts."""
    return Lexicon(*frequent_words(word_counts(docs.select("text"), apart=letters_table(), shortest=SHORTEST, longest=LONGEST), most))


def secrets(docs: DataFrame, words: Lexicon) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, log10_guesses for every row of ``docs``.

    spans: kind:start:end of all spans by start, then kind, in code points, ends exclusive; guess spans are
    values beside a credential word that cost 10 ** LEAST guesses or more and lie in no base span.
    log10_guesses: the greatest cost of such a value (0 without one). Null text is empty; null and repeated
    ids are rows like others; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words.words, words.cost))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "log10_guesses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon.__new__(Lexicon)
        own.words, own.cost = shared.value
        for piece in pieces(batches):
            rows = []
            for text in piece.column(1).to_pylist():
                base, whole, most = scan(text or "", own)
                n = [sum(k == kind for _, k, _ in whole) for kind in range(4)]
                rows.append((*n[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(whole), n[3], most))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, log10_guesses double")
