"""Per-document text quality: line statistics, and a hidden Markov model that labels each line prose, list, table or junk.

No list of words takes part.  A line is described by statistics that every script has: how its characters divide into letters, digits,
marks and symbols, bullets, separators, the end of a sentence, how word lengths scatter, how often words come again, how many letters
differ, how often a clause or sentence ends.  Natural prose mixes short and long words, repeats few of them at once and pauses now and
then; lists, tables, logs, code, encoded data and strung-together words do not.  A single short line proves little, so words
are counted over the lines around it in the same paragraph, and the labels of a text are decided together: the hidden state tends to
stay from line to line, and the Viterbi path is the most likely labelling of the whole text.  Shares of the labels count characters.

Each statistic falls into one of a few bins, and a state gives each bin a chance.  The chances come from ``fit``: Baum-Welch over the lines of
a bounded sample, started from coarse beliefs about each state (``BELIEFS``); what it gave is kept in ``quality_model.json``.
Features of all lines of a batch are computed at once, and the Viterbi step runs over all texts of a batch in parallel.  Texts stay in the
task that reads them, unless the scan has fewer tasks than the cluster has cores; nothing is sampled there.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.arrow import slices
from depotlens.session import spread

LABELS = ("prose", "list", "table", "junk")
#: Lines longer than twice this many characters are judged in pieces of about so many.
PIECE_CHARS = 240
#: Words that the lines around one should have for its word statistics, and how far back a word counts as repeated.
WINDOW_WORDS, REPEAT_WORDS = 40, 60
#: Texts that ``fit`` reads at most, chosen by the hash of their id, and the lines it takes of each.
FIT_TEXTS, FIT_LINES = 4000, 60
#: Words whose share of a text is reported; they decide nothing.
COMMON_WORDS = 150

# ---- characters

SPACE, LETTER, UNSPACED, DIGIT, STOP, CLAUSE, QUOTE, SYMBOL, OTHER = range(9)
#: Blocks of scripts that put no spaces between words: South-East Asian, kana, Han.
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))
_MARKS = {STOP: ".!?…。！？؟۔।።", CLAUSE: ",:;、，：；،؛", QUOTE: "'\"’-–—()", SYMBOL: "[]{}<>"}
#: Format characters that hide inside words.
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200e\u200f\u202a-\u202e\u2060\ufeff]")
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_TOP = 0x32000


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every character, and whether it is upper case."""
    kinds, upper = np.full(_TOP + 1, SYMBOL, np.uint8), np.zeros(_TOP + 1, bool)
    for c in range(_TOP):
        k = unicodedata.category(chr(c))
        if k[0] in "LM":
            kinds[c], upper[c] = LETTER, k in ("Lu", "Lt")
        elif k[0] == "N":
            kinds[c] = DIGIT
        elif k[0] == "Z" or chr(c).isspace():
            kinds[c] = SPACE
        elif k[0] == "C":
            kinds[c] = OTHER
        elif k in ("Pi", "Pf", "Ps", "Pe", "Pd"):
            kinds[c] = QUOTE
    for a, z in _UNSPACED:
        kinds[a:z][kinds[a:z] == LETTER] = UNSPACED
    for kind, marks in _MARKS.items():
        kinds[[ord(c) for c in marks]] = kind
    kinds[0xFFFD] = OTHER
    return kinds, upper


@functools.lru_cache(maxsize=4)
def _among(chars: str) -> np.ndarray:
    out = np.zeros(_TOP + 1, bool)
    out[[ord(c) for c in chars]] = True
    return out


# ---- statistics of lines

#: Bins of each statistic: upper bounds (the last bin has none), or the number of values for those that count.
#: Fixed by what the statistics mean; the first group describes a line alone, the second the words around it.
BINS: dict[str, list[float]] = {
    "bullet": [0.5], "separators": [0.5, 1.5, 3.5], "symbols": [0.01, 0.04, 0.1, 0.2, 0.4], "digits": [0.005, 0.03, 0.1, 0.25], "ended": [0.5], "mixed": [0.02, 0.1, 0.25, 0.5], "longest": [16.5, 26.5, 60.5], "unspaced": [0.25, 0.6], "letters": [0.2, 0.5, 0.7, 0.8, 0.9], "echo": [0.15, 0.3, 0.6], "tokens": [1.5, 2.5, 4.5, 8.5],
    "scatter": [0.12, 0.2, 0.27, 0.33, 0.39, 0.45, 0.52, 0.6, 0.75], "mean": [1.5, 2.5, 3.3, 4.0, 4.7, 5.5, 6.5, 8.0, 11.0], "brief": [0.04, 0.1, 0.16, 0.22, 0.28, 0.35, 0.45, 0.6, 0.8, 0.95], "long": [0.02, 0.08, 0.16, 0.25, 0.4],
    "again": [0.03, 0.08, 0.15, 0.22, 0.3, 0.45, 0.7], "pauses": [0.01, 0.04, 0.08, 0.15, 0.3], "variety": [0.055, 0.065, 0.075, 0.09, 0.12, 0.2], "capitals": [0.02, 0.1, 0.25, 0.5, 0.8, 0.98], "pairs": [-6.5, -6.0, -5.5, -5.0, -4.6, -4.2, -3.8],
}
_OWN = ("bullet", "separators", "symbols", "digits", "ended", "mixed", "longest", "unspaced", "letters", "echo", "tokens")
_AROUND = tuple(n for n in BINS if n not in _OWN)
#: Word statistics take part with this weight, since they depend on each other; fewer words than LEAST_WORDS say nothing.
WORD_WEIGHT, LEAST_WORDS, ENOUGH_WORDS = 1.0, 3, 40

_BULLET = re.compile(r"(?:[-–—*•+·▪◦]|\d{1,3}[.)]|[A-Za-z][.)]|\[[ xX]\])\s")
_SEPARATORS = "\t|;│·>="


def _clean(text: str) -> str:
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _HIDDEN.sub("", text) if _HIDDEN.search(text) else text


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over [start, end) of each line."""
    kind = np.int32 if values.dtype == bool else np.float64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, dtype=kind, out=total[1:])
    return (total[ends] - total[starts]).astype(np.float64)


class Lines:
    """Lines and pieces of lines of many texts, with their statistics; blank ones are left out."""

    def __init__(self, texts: list[str], pairs: np.ndarray | None = None, common: np.ndarray | None = None):
        """``pairs``: logarithms of how often a Latin letter follows another, letters by their last five bits; without them nothing is said.
        ``common``: sorted hashes of common words, which are counted only."""
        self.pairs, self.common_words = pairs, common
        kinds, upper = _characters()
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(code, _TOP)
        kind = kinds[code]
        sizes = np.array([len(t) for t in texts], np.int64)
        text_start = np.cumsum(sizes + 1) - sizes - 1
        # Pieces: between line breaks, and inside long lines at the first blank beyond each multiple of PIECE_CHARS.
        breaks = np.flatnonzero(_among(_BREAKS)[code])
        a, z = np.concatenate([[0], breaks[:-1] + 1]), breaks
        size = z - a
        more = np.maximum(0, (size - 1) // PIECE_CHARS - 1) * (size > 2 * PIECE_CHARS)
        row = np.repeat(np.arange(len(a)), more)
        step = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more) + 1
        target = a[row] + step * PIECE_CHARS
        blanks = np.flatnonzero(code == 32)
        at = np.searchsorted(blanks, target)
        near = blanks[np.minimum(at, len(blanks) - 1)] if len(blanks) else np.zeros(len(target), np.int64)
        cut = np.where((at < len(blanks)) & (near < target + PIECE_CHARS) & (near < z[row]), near, target)
        starts = np.unique(np.concatenate([a, cut]))
        ends = np.minimum(np.concatenate([starts[1:], [len(code)]]), z[np.searchsorted(z, starts, "left").clip(0, len(z) - 1)])
        whole = np.isin(starts, a)
        seen = np.concatenate([[0], np.cumsum(kind != SPACE)])
        visible = seen[ends] - seen[starts]
        keep = visible > 0
        self.text = np.searchsorted(text_start, starts, "right")[keep] - 1
        # A paragraph begins at each text and after each blank line.
        line_of = np.cumsum(whole) - 1
        self.block = np.cumsum(~keep | np.isin(starts, text_start))[keep]
        self.line = line_of[keep]
        starts, ends, visible = starts[keep], ends[keep], visible[keep].astype(np.float64)
        self.n, self.chars, self.visible = len(starts), ends - starts, visible
        self.starts, self.ends, self.joined = starts, ends, joined
        letters = (kind == LETTER) | (kind == UNSPACED)
        self.letters = _sums(letters, starts, ends)
        # How many letters repeat one of the two before: few in words, all in "hahaha".
        echo = np.zeros(len(code), bool)
        echo[1:] = code[1:] == code[:-1]
        echo[2:] |= code[2:] == code[:-2]
        self._own(code, kind, letters, starts, ends)
        self.values["echo"] = _sums(echo & letters, starts, ends) / np.maximum(1.0, self.letters)
        self._around(code, kind, letters, upper, starts, ends)

    def _own(self, code: np.ndarray, kind: np.ndarray, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        v = self.values = {}
        v["symbols"] = _sums((kind == SYMBOL) | (kind == OTHER), starts, ends) / self.visible
        v["digits"] = _sums(kind == DIGIT, starts, ends) / self.visible
        v["letters"] = self.letters / self.visible
        v["unspaced"] = _sums(kind == UNSPACED, starts, ends) / np.maximum(1.0, self.letters)
        # Tokens are what stands between blanks; mixed ones have a digit or symbol among letters, or no letters at all.
        space = kind == SPACE
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        odd = _sums(~(letters | (kind == STOP) | (kind == CLAUSE) | (kind == QUOTE)), first, last) > 0
        f, l = np.searchsorted(first, starts), np.searchsorted(first, ends)
        v["mixed"], v["tokens"] = _sums(odd, f, l) / np.maximum(1, l - f), (l - f).astype(np.float64)
        spaced = np.where(_sums(kind == UNSPACED, first, last) > 0, 0, last - first)
        longest = np.zeros(self.n)
        if len(first):
            run = np.maximum.reduceat(np.concatenate([spaced, [0]]), np.minimum(np.stack([f, l], 1).ravel(), len(spaced)))[::2]
            longest = np.where(l > f, run, 0)
        v["longest"] = longest
        # The last visible character that closes nothing tells whether the piece ends a sentence.
        mark = np.flatnonzero((kind != SPACE) & (kind != QUOTE))
        at = np.searchsorted(mark, ends) - 1
        final = np.where(at >= 0, mark[np.maximum(at, 0)] if len(mark) else 0, 0)
        ended = ((at >= 0) & (final >= starts) & (kind[final] == STOP)).astype(float)
        # Separators: marks of their own, runs of blanks, commas without a blank, and quotes before a comma or colon.
        mark, after = _among(_SEPARATORS)[code], np.append(code[1:], 10)
        mark |= (code == ord(",")) & ~np.append(space[1:], True)
        mark |= (code == ord('"')) & ((after == ord(",")) | (after == ord(":")))
        mark |= space & np.append(space[1:], False) & ~np.concatenate([[True], space[:-1]])
        seen = np.flatnonzero(~space)
        a, z = seen[np.searchsorted(seen, starts)], seen[np.searchsorted(seen, ends) - 1] + 1
        v["separators"], v["ended"] = _sums(mark, a, z) / np.maximum(1.0, self.visible / 60), ended
        head = np.minimum(z, a + 8).tolist()
        v["bullet"] = np.array([_BULLET.match(self.joined[x:y] + " ") is not None for x, y in zip(a.tolist(), head)], float)

    def _around(self, code: np.ndarray, kind: np.ndarray, letters: np.ndarray, upper: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Word statistics over the lines around each, inside its paragraph."""
        word = kind == LETTER
        first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        last = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
        length = (last - first).astype(np.float64)
        lower = np.where(upper[code] & (code < 0x600), code | 32, code)
        offset = np.arange(int(word.sum())) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        with np.errstate(over="ignore"):
            mixed = (lower[word].astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (offset.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
            mixed ^= mixed >> np.uint64(29)
            h = np.add.reduceat(mixed, np.cumsum(last - first) - (last - first)) if len(first) else np.zeros(0, np.uint64)
        self.hashes = h
        # In scripts without spaces each character is a word of its own for repetition.
        alone = np.flatnonzero(kind == UNSPACED)
        capital = upper[code[first]]
        rest = _sums(upper[code], first, last) > 1
        order = np.lexsort((np.arange(len(h)), h))
        again = np.zeros(len(h), bool)
        if len(h) > 1:
            same = (h[order][1:] == h[order][:-1]) & (order[1:] - order[:-1] <= REPEAT_WORDS)
            again[order[1:]] = same
        f, l = np.searchsorted(first, starts), np.searchsorted(first, ends)
        at = np.flatnonzero(letters)
        line_of = np.searchsorted(starts, at, "right") - 1
        cell = np.zeros((self.n, 33))
        cell[:, :32] = np.bincount(line_of * 32 + (lower[at] & 31).astype(np.int64), minlength=self.n * 32)[: self.n * 32].reshape(self.n, 32)
        cell[:, 32] = cell[:, :32].sum(1)
        c = np.searchsorted(alone, starts), np.searchsorted(alone, ends)
        chars = code[alone].astype(np.int64)
        by = np.lexsort((np.arange(len(chars)), chars))
        seen = np.zeros(len(chars), bool)
        if len(chars) > 1:
            seen[by[1:]] = (chars[by][1:] == chars[by][:-1]) & (by[1:] - by[:-1] <= REPEAT_WORDS)
        count = (l - f).astype(np.float64)
        latin = np.zeros(len(code), bool)
        latin[1:] = word[1:] & word[:-1] & (code[1:] < 0x250) & (code[:-1] < 0x250)
        logs = np.zeros(len(code))
        if self.pairs is not None:
            logs[1:][latin[1:]] = self.pairs[lower[:-1][latin[1:]] & 31, lower[1:][latin[1:]] & 31]
        own = {
            "words": count, "length": _sums(length, f, l), "square": _sums(length * length, f, l), "again": _sums(again, f, l), "capital": _sums(capital & ~rest, f, l), "shout": _sums(capital & rest, f, l),
            "latin": _sums(latin, starts, ends), "pairs": _sums(logs, starts, ends), "pauses": _sums((kind == STOP) | (kind == CLAUSE), starts, ends), "unspaced": (c[1] - c[0]).astype(np.float64), "seen": _sums(seen, *c),
        }
        # The window: lines before and after in the paragraph until there are enough words on either side.
        weight = own["words"] + own["unspaced"] / 2
        reach = np.concatenate([[0], np.cumsum(weight)])
        middle = (reach[:-1] + reach[1:]) / 2
        new = np.concatenate([[True], self.block[1:] != self.block[:-1]]) if self.n else np.zeros(0, bool)
        block_start = np.flatnonzero(new)[np.cumsum(new) - 1] if self.n else np.zeros(0, np.int64)
        block_end = np.append(np.flatnonzero(new)[1:], self.n)[np.cumsum(new) - 1] if self.n else np.zeros(0, np.int64)
        lo = np.maximum(block_start, np.searchsorted(reach, middle - WINDOW_WORDS / 2, "right") - 1).clip(0)
        hi = np.minimum(block_end, np.searchsorted(reach, middle + WINDOW_WORDS / 2, "left"))
        hi = np.maximum(hi, np.arange(self.n) + 1)
        w = {k: _sums(x, lo, hi) for k, x in own.items()}
        words = np.maximum(1.0, w["words"])
        # Two characters of a script without spaces are counted as a word.
        self.words, self.word_letters = own["words"] + own["unspaced"] / 2, own["length"] + own["unspaced"]
        self.common = _sums(np.isin(h, self.common_words), f, l) if self.common_words is not None else np.zeros(self.n)
        mean = w["length"] / words
        spread_ = np.sqrt(np.maximum(0.0, w["square"] / words - mean * mean))
        # Long is relative to the mean, so that it means the same in every language; brief words have up to three letters.
        edge = np.repeat(mean, l - f)
        belongs = np.repeat(f, l - f) + np.arange(len(edge)) - np.repeat(np.cumsum(l - f) - (l - f), l - f)
        here = length[belongs] if len(belongs) else np.zeros(0)
        ends_at = np.cumsum(l - f)
        long_ = _sums(here >= 1.5 * edge, ends_at - (l - f), ends_at)
        v = self.values
        v["scatter"], v["mean"] = spread_ / np.maximum(mean, 0.1), mean
        v["brief"], v["long"] = _sums(_sums(length <= 3, f, l), lo, hi) / words, _sums(long_, lo, hi) / words
        v["again"], v["capitals"] = w["again"] / words, w["capital"] / np.maximum(1.0, w["words"] - w["shout"])
        v["pauses"] = w["pauses"] / words
        v["pairs"] = w["pairs"] / np.maximum(1.0, w["latin"])
        self.latin = (w["latin"] >= 8) & (2 * w["latin"] >= w["length"] - w["words"]) & (self.pairs is not None)
        total = np.concatenate([np.zeros((1, 33)), np.cumsum(cell, 0)])
        around = total[hi] - total[lo]
        v["variety"] = (around[:, :32] ** 2).sum(1) / np.maximum(1.0, around[:, 32]) ** 2
        # Scripts without spaces: characters stand for words, runs between marks are not scattered.
        dense = w["unspaced"] > w["length"]
        n = np.maximum(1.0, w["unspaced"])
        self.dense = dense
        v["again"] = np.where(dense, w["seen"] / n, v["again"])
        v["pauses"] = np.where(dense, w["pauses"] / n, v["pauses"])
        self.counted = np.where(dense, w["unspaced"] / 2, w["words"])
        self.own_share = np.where(dense, own["unspaced"] / n, own["words"] / words).clip(0, 1)

    def weight(self, name: str) -> np.ndarray:
        """How much a statistic says at each line: all of it about the line alone; of the words around, the line's part, and less when they
        are few, but pairs of letters are many at once."""
        if name in _OWN:
            return np.ones(self.n)
        part = np.minimum(1.0, 1.5 * self.own_share)
        return part if name == "pairs" else WORD_WEIGHT * part * np.minimum(1.0, self.counted / ENOUGH_WORDS)

    def binned(self) -> np.ndarray:
        """Bin of each statistic, a column for each name of BINS; -1 where it says nothing."""
        out = np.stack([np.searchsorted(b, self.values[n]) for n, b in BINS.items()], 1) if self.n else np.zeros((0, len(BINS)), np.int64)
        names = list(BINS)
        few = self.counted < LEAST_WORDS
        for n in _AROUND:
            out[few | (~self.latin & (n == "pairs")) | (self.dense & (n in ("scatter", "mean", "brief", "long", "capitals", "variety"))), names.index(n)] = -1
        out[self.values["unspaced"] > 0.25, names.index("mixed")] = -1
        out[self.values["unspaced"] > 0.25, names.index("tokens")] = -1
        return out


def frequent_words(texts: list[str]) -> list[str]:
    """The COMMON_WORDS words that most texts have."""
    words: dict[str, int] = {}
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            words[w] = words.get(w, 0) + 1
    return sorted(sorted(words, key=lambda w: (-words[w], w))[:COMMON_WORDS])


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Logarithms (base 2) of the chance that a Latin letter follows another, from the words that at least two texts have."""
    words: dict[str, int] = {}
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]{2,}", t.lower())):
            words[w] = words.get(w, 0) + 1
    counts = np.full((32, 32), 0.02)
    for w, n in words.items():
        if n > 1 and max(w) < "\u0250":
            c = [ord(x) & 31 for x in w]
            for a, b in zip(c, c[1:]):
                counts[a, b] += np.log2(n)
    return np.log2(counts / counts.sum(1, keepdims=True))


# ---- the model

#: States, the label of each, and what is believed of it before the fit: for some statistics the values that it mostly has.
BELIEFS: dict[str, tuple[str, dict[str, tuple[float, float]]]] = {
    "prose": ("prose", {"letters": (0.7, 1), "echo": (0, 0.3), "tokens": (3, 99), "pairs": (-4.6, 0), "bullet": (0, 0), "separators": (0, 0), "symbols": (0, 0.04), "digits": (0, 0.03), "mixed": (0, 0.1), "longest": (0, 26), "scatter": (0.39, 0.75), "mean": (3.3, 8), "brief": (0.16, 0.6), "long": (0.08, 0.4), "again": (0, 0.45), "pauses": (0.01, 0.3), "variety": (0, 0.09), "capitals": (0, 0.5)}),
    "dense prose": ("prose", {"letters": (0.7, 1), "echo": (0, 0.3), "unspaced": (0.6, 1), "longest": (0, 9999), "bullet": (0, 0), "separators": (0, 0), "symbols": (0, 0.04), "digits": (0, 0.1), "again": (0.03, 0.7), "pauses": (0.01, 0.3)}),
    "prose of long words": ("prose", {"letters": (0.7, 1), "echo": (0, 0.3), "tokens": (3, 99), "bullet": (0, 0), "separators": (0, 0), "symbols": (0, 0.04), "digits": (0, 0.03), "mixed": (0, 0.1), "longest": (0, 26), "scatter": (0.27, 0.6), "mean": (5.5, 11), "brief": (0.04, 0.28), "again": (0, 0.15), "pauses": (0.04, 0.3), "variety": (0, 0.12), "capitals": (0, 0.25), "pairs": (-5.5, 0)}),
    "prose of syllables": ("prose", {"letters": (0.7, 1), "echo": (0, 0.3), "tokens": (3, 99), "bullet": (0, 0), "separators": (0, 0), "symbols": (0, 0.04), "digits": (0, 0.03), "mixed": (0, 0.1), "longest": (0, 16), "scatter": (0.2, 0.52), "mean": (1.5, 4.6), "brief": (0.22, 1), "again": (0, 0.15), "pauses": (0.01, 0.3), "variety": (0, 0.12), "capitals": (0, 0.25)}),
    "list": ("list", {"bullet": (1, 1), "separators": (0, 1.5), "ended": (0, 0), "pauses": (0, 0.15)}),
    "names": ("list", {"tokens": (1, 99), "capitals": (0.8, 1), "again": (0.3, 1), "ended": (0, 0), "mixed": (0.25, 1)}),
    "items": ("list", {"tokens": (1, 2), "ended": (0, 0), "symbols": (0, 0.04)}),
    "table": ("table", {"longest": (0, 9999), "separators": (2, 99), "digits": (0.1, 1), "mixed": (0.25, 1), "ended": (0, 0)}),
    "log": ("junk", {"longest": (0, 9999), "digits": (0.1, 1), "mixed": (0.25, 1), "separators": (0, 2), "ended": (0, 0)}),
    "code": ("junk", {"longest": (0, 9999), "symbols": (0.1, 1), "mixed": (0.25, 1), "ended": (0, 0), "pauses": (0.3, 9)}),
    "encoded": ("junk", {"longest": (61, 9999), "mixed": (0.5, 1), "ended": (0, 0)}),
    "signs": ("junk", {"longest": (0, 9999), "letters": (0, 0.2)}),
    "strung": ("junk", {"symbols": (0, 0.01), "digits": (0, 0.005), "mixed": (0, 0.02), "scatter": (0, 0.33), "mean": (4.7, 11), "brief": (0, 0.1), "long": (0, 0.16), "pauses": (0, 0.08), "separators": (0, 0)}),
    "again": ("junk", {"again": (0.7, 1), "scatter": (0, 0.2), "mixed": (0, 0.02), "pauses": (0, 0.01)}),
    "laughs": ("junk", {"longest": (0, 9999), "echo": (0.6, 1)}),
    "mashed": ("junk", {"pairs": (-99, -5.5), "scatter": (0.45, 2), "pauses": (0, 0.08), "capitals": (0, 0.02)}),
    "small words": ("junk", {"mean": (0, 3.3), "brief": (0.6, 1), "pauses": (0, 0.01), "mixed": (0, 0.02), "scatter": (0, 0.45), "symbols": (0, 0.01), "digits": (0, 0.005)}),
}
#: Chance of all believed bins together, weight of the beliefs in lines, and the chance that a state stays.
BELIEVED, BELIEF_LINES, STAY = 0.9, 800.0, 0.9
#: Statistics whose beliefs the fit leaves nearly as they are: they say what the word bullet or script means.
FIRM, FIRM_LINES, FIRM_BELIEVED = ("bullet", "unspaced", "echo", "letters", "longest", "tokens"), 1e5, 0.998
#: States of languages that a corpus may lack: their beliefs are firm too, lest the fit gives the states to something else.
FIRM_STATES, SELDOM_BELIEVED = ("prose of long words", "prose of syllables"), 0.95
_LABEL_OF = np.array([LABELS.index(label) for label, _ in BELIEFS.values()])


def believed() -> dict[str, np.ndarray]:
    """For each statistic the chances of its bins in each state, by the beliefs alone."""
    out = {}
    for n, edges in BINS.items():
        bins = len(edges) + 1
        rows = []
        for name, (_, facts) in BELIEFS.items():
            facts = {"unspaced": (0, 0.25), "longest": (0, 60)} | facts  # unless said otherwise, words have spaces between them
            if n in facts:
                a, z = np.searchsorted(edges, facts[n][0], "right" if facts[n][0] in edges else "left"), np.searchsorted(edges, facts[n][1])
                inside = (np.arange(bins) >= a) & (np.arange(bins) <= max(a, z))
                sure = FIRM_BELIEVED if n in FIRM else SELDOM_BELIEVED if name in FIRM_STATES else BELIEVED
                p = np.where(inside, sure / inside.sum(), (1 - sure) / max(1, bins - inside.sum())) if not inside.all() else np.full(bins, 1 / bins)
            else:
                p = np.full(bins, 1 / bins)
            rows.append(p)
        out[n] = np.array(rows)
    return out


def evidence(lines: Lines, chances: dict[str, np.ndarray]) -> np.ndarray:
    """Log-likelihood of each state for each line."""
    bins = lines.binned()
    out = np.zeros((lines.n, len(BELIEFS)))
    for i, n in enumerate(BINS):
        table = np.concatenate([np.log(chances[n]).T, np.zeros((1, len(BELIEFS)))])  # the last row is for -1
        out += table[bins[:, i]] * lines.weight(n)[:, None]
    return out


def _steps(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines: their first lines and numbers of lines, and how many texts have a line of each number."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.append(first, len(text)))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    return first, count, np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")


def viterbi(text: np.ndarray, scores: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Most likely state of each line; all texts (numbers rising along the lines) take their steps together."""
    if not len(text):
        return np.zeros(0, np.int64)
    first, count, active = _steps(text)
    back, into = np.zeros(scores.shape, np.int8), np.ascontiguousarray(move.T)
    now = start + scores[first]
    for i in range(1, len(active)):
        k = active[i]
        ways = now[:k, None, :] + into  # from the last axis
        at = first[:k] + i
        back[at] = ways.argmax(2)
        now[:k] = ways.max(2) + scores[at]
    out = np.zeros(len(text), np.int64)
    state = now.argmax(1)
    for i in range(len(active) - 1, -1, -1):
        k = active[i]
        out[first[:k] + i] = state[:k]
        if i:
            state[:k] = back[first[:k] + i, state[:k]]
    return out


def _posteriors(text: np.ndarray, scores: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each state at each line, and expected numbers of moves, by forward and backward passes."""
    first, count, active = _steps(text)
    e = np.exp(scores - scores.max(1, keepdims=True))
    p, q = np.exp(start), np.exp(move)
    ahead, behind = np.zeros(e.shape), np.ones(e.shape)
    now = p * e[first]
    now /= now.sum(1, keepdims=True)
    ahead[first] = now
    for i in range(1, len(active)):
        at = first[: active[i]] + i
        now = (ahead[at - 1] @ q) * e[at]
        ahead[at] = now / now.sum(1, keepdims=True)
    moves = np.zeros(q.shape)
    for i in range(len(active) - 1, 0, -1):
        at = first[: active[i]] + i
        w = e[at] * behind[at]
        moves += ((ahead[at - 1] / np.maximum(1e-300, (ahead[at - 1] * (w @ q.T)).sum(1, keepdims=True))).T @ w) * q
        b = w @ q.T
        behind[at - 1] = b / b.sum(1, keepdims=True)
    both = ahead * behind
    return both / both.sum(1, keepdims=True), moves


def fit_model(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> dict:
    """``fit`` on at most FIT_TEXTS texts that are not blank, those with the smallest hashes of their id."""
    rows = documents.where(F.col(text).isNotNull() & (F.trim(text) != "")).orderBy(F.xxhash64(doc), doc).limit(FIT_TEXTS)
    return fit([r[0] for r in rows.select(text).collect()])


def fit(texts: list[str], rounds: int = 12) -> dict:
    """Baum-Welch on the lines of the given texts, FIT_LINES of each, started from and held by BELIEFS.

    Callers give at most FIT_TEXTS texts.  Gives the model as plain lists: chances of each statistic's bins by state, of first states and
    of moves.  Labels are never given: what a state means comes from its beliefs."""
    texts = [_clean(t) for t in texts]
    pairs = letter_pairs(texts)
    lines = Lines(texts, pairs)
    rank = np.arange(lines.n) - np.flatnonzero(np.concatenate([[True], lines.text[1:] != lines.text[:-1]]))[np.cumsum(np.concatenate([[True], lines.text[1:] != lines.text[:-1]])) - 1]
    take = rank < FIT_LINES
    text, bins = lines.text[take], lines.binned()[take]
    prior, k = believed(), len(BELIEFS)
    chances, start = dict(prior), np.full(k, 1 / k)
    move = np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1))
    for _ in range(rounds):
        scores = evidence(lines, chances)[take]
        g, moves = _posteriors(text, scores, np.log(start), np.log(move))
        for i, n in enumerate(BINS):
            seen = bins[:, i] >= 0
            w = g[seen] * lines.weight(n)[take][seen, None]
            counts = np.stack([np.bincount(bins[seen, i], w[:, s], len(BINS[n]) + 1) for s in range(k)])
            held = np.array([FIRM_LINES if n in FIRM or name in FIRM_STATES else BELIEF_LINES for name in BELIEFS])
            smooth = counts + held[:, None] * prior[n]
            chances[n] = smooth / smooth.sum(1, keepdims=True)
        first = g[np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))].sum(0) + 10
        start = first / first.sum()
        m = moves + 1 + 100 * np.eye(k)
        move = m / m.sum(1, keepdims=True)
    return {"states": list(BELIEFS), "pairs": pairs.round(3).tolist(), "common": frequent_words(texts), "chances": {n: chances[n].round(6).tolist() for n in BINS}, "start": start.round(6).tolist(), "move": move.round(6).tolist()}


class Model:
    """A fitted model in the form that the workers use."""

    def __init__(self, fitted: dict):
        if fitted["states"] != list(BELIEFS):
            raise ValueError("the model was fitted for other states")
        self.chances = {n: np.array(fitted["chances"][n]) for n in BINS}
        self.start, self.move, self.pairs = np.log(np.array(fitted["start"])), np.log(np.array(fitted["move"])), np.array(fitted["pairs"])
        self.common = np.unique(Lines(fitted["common"]).hashes)

    def statistics(self, texts: list[str | None]) -> dict[str, list]:
        """The values of FIELDS for each text; a null, empty or blank text has no lines, and null where nothing can be divided."""
        lines = Lines([_clean(t or "") for t in texts], self.pairs, self.common)
        label = _LABEL_OF[viterbi(lines.text, evidence(lines, self.chances), self.start, self.move)]
        total = lambda values: np.bincount(lines.text, values, len(texts))
        last = np.append(lines.line[1:] != lines.line[:-1], True) if lines.n else np.zeros(0, bool)
        n_lines, words, visible, chars = total(last), total(lines.words), total(lines.visible), total(lines.chars)
        marks = total(lines.visible - lines.letters - lines.values["digits"] * lines.visible)
        ratio = lambda a, b: [float(x) if y else None for x, y in zip(a / np.maximum(b, 1e-9), b)]
        out = {
            "n_chars": [None if t is None else len(t) for t in texts], "n_lines": n_lines.astype(np.int64).tolist(), "n_words": words.astype(np.int64).tolist(), "mean_word_length": ratio(total(lines.word_letters), words),
            "symbol_ratio": ratio(marks, visible), "ended_lines": ratio(total(lines.values["ended"] * last), n_lines), "common_words": ratio(total(lines.common), words),
        }
        return out | {name: ratio(total(lines.chars * (label == i)), chars) for i, name in enumerate(LABELS)}


def default_model() -> dict:
    """What ``fit_model`` gave for the test data's documents at scale 0.1."""
    import pkgutil

    return json.loads(pkgutil.get_data(__package__, "quality_model.json"))


FIELDS = [
    ("n_chars", "bigint"), ("n_lines", "bigint"), ("n_words", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("ended_lines", "double"), ("common_words", "double"),
    ("prose", "double"), ("list", "double"), ("table", "double"), ("junk", "double"),
]


#: Bytes of texts whose lines are taken together.
TOGETHER_BYTES = 4 << 20


def text_statistics(documents: DataFrame, doc: str = "doc_id", text: str = "text", fitted: dict | None = None) -> DataFrame:
    """(doc_id, FIELDS...) of every document.

    Nulls, empty and blank texts have n_lines 0 and null shares; texts of any length are read whole; repeated rows are repeated;
    extra columns are ignored.  ``fitted``: a model of ``fit_model``; by default the one kept here.
    """
    kinds, fitted = {"bigint": pa.int64(), "double": pa.float64()}, fitted or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(fitted)
        for b in slices(batches, "text", TOGETHER_BYTES):
            got = model.statistics(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(got[n], kinds[k]) for n, k in FIELDS)], names=["doc_id", *(n for n, _ in FIELDS)])

    source = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    types = {"bigint": T.LongType(), "double": T.DoubleType()}
    return spread(source).mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *(T.StructField(n, types[k]) for n, k in FIELDS)]))


def not_prose(statistics: DataFrame) -> DataFrame:
    """Texts less than half of whose characters are in prose lines; texts without lines are no cases."""
    return statistics.where("n_lines > 0 AND prose < 0.5")


if __name__ == "__main__":  # python -m depotlens.llm.quality FOLDER: fits the model on a folder's documents and keeps it
    import sys

    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").getOrCreate()
    made = fit_model(session.read.parquet(f"{sys.argv[1]}/documents.parquet"))
    (Path(__file__).parent / "quality_model.json").write_text(json.dumps(made, separators=(",", ":")) + "\n")
