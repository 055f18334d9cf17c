"""Alignments of two sequences within one recording, as Arrow functions over arrays of words."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from prosodia.functions.deferred import array_function

#: Placeholder for the missing side of an unequal replacement.
NONE = "—"

WORDS = "array<struct<word:string,start:double,end:double,conf:double,timing_source:string>>"


#: So many words of a batch are Python objects at once.
AT_ONCE = 1 << 16


def _plain(x) -> list:
    return [] if x is None else list(x)


def _by_pieces(left: pa.Array, right: pa.Array, f: Callable[[list, list], dict | list | tuple], kind: pa.DataType) -> pa.Array:
    """``f`` of each row of two list columns; of a batch only some rows at a time leave Arrow's memory."""
    words = (left.value_lengths().fill_null(0).to_numpy() + right.value_lengths().fill_null(0).to_numpy()).cumsum() if len(left) else np.empty(0)
    made, s = [], 0
    while s < len(left):
        e = max(s + 1, int(np.searchsorted(words, (words[s - 1] if s else 0) + AT_ONCE, side="right")))
        rows = zip(left.slice(s, e - s).to_pylist(), right.slice(s, e - s).to_pylist(), strict=True)
        made.append(pa.array([f(a or [], b or []) for a, b in rows], kind))
        s = e
    return pa.concat_arrays(made) if made else pa.array([], kind)


def align(system: list[str], ground: list[str]) -> list[tuple[int | None, int | None]]:
    """Full outer alignment of least cost: equal (whatever the case) 0, unequal pair 2, skip 1.

    Of equal costs a pair comes before skipping a ground word before skipping a system word.
    """
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(w.lower(), len(codes)) for w in x], dtype=np.int64) for x in (system, ground))
    along = np.arange(len(b) + 1)

    def below(row: np.ndarray, word: int) -> np.ndarray:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(b == word, 0, 2))
        # skipping ground words adds one each: a running minimum
        return np.minimum.accumulate(new - along) + along

    # rows of costs are kept at every step-th word and made again block by block on the way back: memory grows with a root
    step = max(1, int(np.sqrt(len(a))))
    row, marks = along, [along]
    for i, word in enumerate(a, 1):
        row = below(row, word)
        if i % step == 0:
            marks.append(row)
    out, i, j = [], len(a), len(b)
    first, cost = len(a) + 1, []
    while i or j:
        if i and i <= first:
            first = (i - 1) // step * step
            cost = [marks[first // step]]
            for word in a[first:i]:
                cost.append(below(cost[-1], word))
        here, above = (cost[i - first], cost[i - first - 1]) if i else (along, None)
        if i and j and here[j] == above[j - 1] + (0 if a[i - 1] == b[j - 1] else 2):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif j and here[j] == here[j - 1] + 1:
            j -= 1
            out.append((None, j))
        else:
            i -= 1
            out.append((i, None))
    return out[::-1]


_PAIRS = pa.list_(pa.struct([("system_idx", pa.int32()), ("ground_idx", pa.int32())]))


@array_function("array<struct<system_idx:int,ground_idx:int>>")
def aligned(system: pa.Array, ground: pa.Array) -> pa.Array:
    return _by_pieces(system, ground, lambda a, b: [{"system_idx": i, "ground_idx": j} for i, j in align(a, b)], _PAIRS)


def diff_words(expected: list[str], got: list[str]) -> dict:
    """Correct, substituted, missed and inserted words of a difference with popular words ignored in long texts."""
    out: dict = {"correct": [], "substituted": [], "missed": [], "inserted": []}
    for tag, a, b, c, d in SequenceMatcher(None, expected, got).get_opcodes():
        left, right = expected[a:b], got[c:d]
        if tag == "equal":
            out["correct"] += left
        elif tag == "replace":
            n = max(len(left), len(right))
            pad = lambda x, n=n: x + [NONE] * (n - len(x))
            out["substituted"] += [{"expected": x, "got": y} for x, y in zip(pad(left), pad(right), strict=True)]
        elif tag == "delete":
            out["missed"] += left
        else:
            out["inserted"] += right
    return out


_WORDS = pa.list_(pa.string())
_DIFFERENCE = pa.struct([("correct", _WORDS), ("substituted", pa.list_(pa.struct([("expected", pa.string()), ("got", pa.string())]))), ("missed", _WORDS), ("inserted", _WORDS)])


@array_function("correct array<string>, substituted array<struct<expected:string,got:string>>, missed array<string>, inserted array<string>")
def word_diff(expected: pa.Array, got: pa.Array) -> pa.Array:
    return _by_pieces(expected, got, diff_words, _DIFFERENCE)


def diff_syllables(reference: list[str], recognised: list[str]) -> tuple[list[dict], float]:
    """Errors by position (from 1) with their type, and the share of matching units."""
    matcher = SequenceMatcher(None, reference, recognised)
    errors = []
    for tag, a, b, c, d in matcher.get_opcodes():
        if tag == "replace":
            for k in range(max(b - a, d - c)):
                x = reference[a + k] if a + k < b else NONE
                y = recognised[c + k] if c + k < d else NONE
                errors.append({"position": a + k + 1, "expected": x, "got": y, "type": "substitution"})
        elif tag == "delete":
            errors += [{"position": a + k + 1, "expected": x, "got": NONE, "type": "deletion"} for k, x in enumerate(reference[a:b])]
        elif tag == "insert":
            errors += [{"position": a + 1, "expected": NONE, "got": y, "type": "insertion"} for y in recognised[c:d]]
    return errors, matcher.ratio()


_ERRORS = pa.struct([("errors", pa.list_(pa.struct([("position", pa.int32()), ("expected", pa.string()), ("got", pa.string()), ("type", pa.string())]))), ("match_ratio", pa.float64())])


@array_function("errors array<struct<position:int,expected:string,got:string,type:string>>, match_ratio double")
def syllable_diff(reference: pa.Array, recognised: pa.Array) -> pa.Array:
    return _by_pieces(reference, recognised, lambda a, b: dict(zip(("errors", "match_ratio"), diff_syllables(a, b), strict=True)), _ERRORS)


def transfer_times(texts: list[dict], timed: list[dict]) -> list[dict]:
    """The words of one recogniser with the times of another.

    Equal words and one-for-one replacements take the other's times; a longer replacement is scaled linearly into
    the other's block; words the other lacks keep their own times; words only the other has are dropped.
    """
    out = []
    ops = SequenceMatcher(None, [w["word"] for w in texts], [w["word"] for w in timed], autojunk=False).get_opcodes()
    for tag, a, b, c, d in ops:
        if tag == "delete":
            out += [dict(w, timing_source="text") for w in texts[a:b]]
        elif tag == "equal" or (tag == "replace" and b - a == d - c == 1):
            out += [dict(w, start=v["start"], end=v["end"], timing_source="times") for w, v in zip(texts[a:b], timed[c:d], strict=True)]
        elif tag == "replace":
            own, other = texts[a:b], timed[c:d]
            begin, to = own[0]["start"], other[0]["start"]
            scale = max(other[-1]["end"] - to, 1e-6) / max(own[-1]["end"] - begin, 1e-6)
            out += [dict(w, start=to + (w["start"] - begin) * scale, end=to + (w["end"] - begin) * scale, timing_source="times") for w in own]
    return out


_TIMED = pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("conf", pa.float64()), ("timing_source", pa.string())]))


@array_function(WORDS)
def merged_times(texts: pa.Array, timed: pa.Array) -> pa.Array:
    return _by_pieces(texts, timed, transfer_times, _TIMED)


def edit_counts(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of a least edit; of equal totals the least (S, D, I)."""
    # total and S in one integer; deletions less insertions are the difference of the lengths, so these two tell D and I
    one = 1 << 32
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(w, len(codes)) for w in x] for x in (reference, hypothesis))
    b = np.array(b, dtype=np.int64)
    along = np.arange(len(b) + 1, dtype=np.int64) * one
    row = along
    for x in a:
        new = row + one
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(b == x, 0, one + 1))
        row = np.minimum.accumulate(new - along) + along
    total, substituted = int(row[-1]) >> 32, int(row[-1]) & (one - 1)
    deleted = (total - substituted + len(a) - len(b)) // 2
    return substituted, deleted, total - substituted - deleted


_EDITS = pa.struct([("s", pa.int32()), ("d", pa.int32()), ("i", pa.int32())])


@array_function("s int, d int, i int")
def edits(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return _by_pieces(reference, hypothesis, lambda a, b: dict(zip("sdi", edit_counts(a, b), strict=True)), _EDITS)
