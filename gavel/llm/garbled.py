"""Text that was decoded with the wrong character encoding: finding it and restoring the original.

1. One pass splits the rows by a pattern of all sequences that UTF-8 bytes can become under the charsets below (also
   with bytes lost as `?` or U+FFFD), or byte-swapped UTF-16. Rows without any are clean; a character n-gram model is
   trained on all of them. HTML references are resolved first. Rows that only look decodable, because nothing in them
   gives characters of the alphabet of the clean rows (names in other scripts, say), are clean as well, and added.
2. The other rows, a small table, are scored: every chain of wrong decodings is undone where that gives characters of
   the clean alphabet, and the model compares each changed span, in its context, with the original. The likeliest chain
   is accepted where it gains more than a margin, and the search goes on in what it left. No sequence goes beyond a run
   of characters other than ASCII, so each different run is decoded once and kept.
3. Any of the charsets may also have been read as any other: words with `RUN` or more of its letters in a row are undone
   by every pair of them. Such rows may well be clean, so the model is trained on them too, forgets the row that it
   judges, and a word must gain more for each letter than the clean ones do. (The same garbled words in many rows
   support each other, and are not found.)
4. The margins follow from how rare suspects are, and are validated before on all clean rows: every character beyond
   Latin-1's controls, in each different surrounding and as often as it stands there, is garbled by every chain and shows
   how much the hardest span gains; every word that a pair of charsets decodes shows how little clean ones gain. What
   reaches the driver are counts by gain, in steps of a hundredth, so quantiles are those of all spans and words.

A row with U+FFFD is a case without any comparison: only a failed decoding writes that character.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.charmodel import COUNT_FIELDS, STEP, Counts, Model, gather, points
from gavel.sources.staging import stage

#: Charsets that UTF-8 may have been read as (fixed values).
CHARSETS = (
    "cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "koi8-r", "cp866",
    "cp1250", "iso8859-2", "iso8859-15", "cp1253", "cp1254", "mac_cyrillic", "iso8859-5", "cp1256",
)
#: Chains of two wrong decodings, the first one first.
TWICE = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("mac_roman", "mac_roman"), ("cp1251", "cp1251"))
CHAINS = (*((c,) for c in CHARSETS), *TWICE)
LOST = ("?", "�")
#: Characters that clean text may have even if this corpus' clean rows don't: Latin letters, Devanagari, punctuation, currency.
COMMON = "".join(map(chr, [*range(0xA1, 0xAC), *range(0xAE, 0x180), *range(0x904, 0x93A), *range(0x93C, 0x94E), *range(0x958, 0x970)])) + "–—‘’“”•…₹€™ \ufeff"
#: The margins where clean rows show nothing, and the share of spans and words that may be harder than what sets them.
LEAST_MARGIN, LEAST_RUN_MARGIN, HARDER = 3.0, 2.0, 1 / 2_000
#: Different surroundings that a task holds before it passes their counts on, and those that are scored at once.
HELD_WINDOWS, SCORED_WINDOWS = 200_000, 500
#: Steps of a unit in which gains are counted, and the largest one.
STEPS, LARGEST = 100, 100
#: Letters in a row that a word needs to be undone by a pair of charsets, and letters of a charset that clean rows must have.
RUN, SCRIPT_LETTERS = 3, 20
#: Characters beyond ASCII in a row, with lost bytes: a sequence of wrongly decoded bytes never goes beyond.
PIECE = re.compile("[^\x00-\x7f][^\x00-\x3e\x40-\x7f]*")
#: Pieces or words, with their decodings, that are kept for when they come again, and the characters of the longest one kept.
HELD_PIECES, LONGEST_HELD = 200_000, 100
#: Characters of a text's spans that are scored at once, if one chain has no more.
SCORED = 200_000


@cache
def _table(charset: str) -> list[str]:
    """What each byte from 0x80 becomes; bytes that the charset doesn't define become the control of that number."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _undefined(charset: str) -> set[int]:
    return {0x80 + k for k, c in enumerate(_table(charset)) if 0x80 <= ord(c) < 0xA0}


def _shape(charset: str, q=re.escape, quiet: bool = False) -> str:
    """A pattern of one UTF-8 sequence of 2 to 4 bytes read as `charset`."""
    t = _table(charset)
    part = lambda a, b: "".join(q(c) for c in t[a - 0x80 : b - 0x80])
    tail = f"[{part(0x80, 0xC0)}?�]"
    return f"[{part(0xC2, 0xE0)}]{tail}|[{part(0xE0, 0xF0)}]{tail}{{2}}|[{part(0xF0, 0xF5)}]{tail}{{3}}"


def _q2(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


SWAPPED = "[" + "".join(map(chr, range(0x2000, 0x7F00, 0x100))) + "]{2,}"


@cache
def _suspect() -> str:
    parts = [_shape(c, _q2).replace("?�]", "?\\x{fffd}]") for c in CHARSETS]
    swapped = "[" + "".join(_q2(chr(x)) for x in range(0x2000, 0x7F00, 0x100)) + "]{2,}"
    return "|".join([*parts, swapped, "\\x{fffd}"])


@cache
def _upper() -> str:
    """All letters beyond ASCII of the charsets."""
    return "".join(sorted({c for charset in CHARSETS for c in _table(charset) if c.isalpha()}))


@cache
def _runs() -> str:
    return "[" + "".join(_q2(c) for c in _upper()) + f"]{{{RUN},}}"


def _resolved(texts: pa.Array) -> pa.Array:
    """The texts with HTML references replaced by their characters."""
    texts = pc.replace_substring(texts, "&nbsp;", " ")
    has = pc.fill_null(pc.match_substring_regex(texts, "&#|&[A-Za-z]+[0-9]*;"), False)
    if not pc.any(has).as_py():
        return texts
    return pc.replace_with_mask(texts, has, pa.array([html.unescape(t) for t in texts.filter(has).to_pylist()], pa.string()))


class Windows:
    """Counts of the characters beyond Latin-1's controls with two characters on both sides, over all texts added since `taken`."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()

    def add(self, texts: Iterable[str]) -> None:
        held, size = ["\n"], 0
        for text in texts:
            if len(text) > STEP:  # in parts, each with two more on both sides
                for at in range(0, len(text), STEP):
                    self._add(["\n", text[max(0, at - 2) : at + STEP + 2]], min(at, 2), min(max(0, len(text) - at - STEP), 2))
                continue
            held.append(text)
            size += len(text)
            if size > STEP:
                self._add(held)
                held, size = ["\n"], 0
        self._add(held)

    def _add(self, held: list[str], before: int = 0, after: int = 0) -> None:
        p = points("\n\n".join([*held, "\n"]))
        start = 3 + before  # the first text begins after "\n\n\n"
        at = np.flatnonzero(p[start : len(p) - 3 - after] > 0x9F) + start
        if not len(at):
            return
        near = p[at[:, None] + np.arange(-2, 3)]
        h = np.zeros(len(at), np.uint64)
        for k in range(5):
            h = (h ^ near[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        _, first, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        kinds = near[first]
        if not (kinds[which] == near).all():  # two surroundings of one hash
            kinds, count = np.unique(near, axis=0, return_counts=True)
        text = np.ascontiguousarray(kinds).tobytes().decode("utf-32-le", "surrogatepass")
        for k, n in enumerate(count.tolist()):
            self.counts[text[5 * k : 5 * k + 5]] += n

    def taken(self) -> tuple[list[str], list[int]]:
        out = list(self.counts), list(self.counts.values())
        self.counts = Counter()
        return out


def _split(batches: Iterator[pa.RecordBatch], keys: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    counts, windows, total = Counts(), Windows(), 0
    names = [*keys, "text", *(n for n, _ in COUNT_FIELDS), "kind"]

    def rows(held: pa.RecordBatch | None, kind: str, extra=None, texts: list[str] | None = None) -> pa.RecordBatch:
        n = len(held) if held is not None else len(extra[1])
        own = [held.column(k) for k in range(len(keys) + 1)] if held is not None else [*(pa.nulls(n, t) for t in types), pa.nulls(n, pa.string()) if texts is None else pa.array(texts, pa.string())]
        number = [pa.array(x, t) for x, (_, t) in zip(extra, COUNT_FIELDS, strict=True)] if extra else [pa.nulls(n, t) for _, t in COUNT_FIELDS]
        return pa.RecordBatch.from_arrays([*own, *number, pa.array([kind] * n, pa.string())], names)

    def passed_on() -> pa.RecordBatch:
        texts, count = windows.taken()
        return rows(None, "window", ([None] * len(texts), [None] * len(texts), count), texts)

    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            total += batch.num_rows
            texts = _resolved(pc.fill_null(batch.column(len(keys)), ""))
            batch = pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), texts], [*keys, "text"])
            hit = pc.match_substring_regex(texts, _suspect())
            yield rows(batch.filter(hit), "hit")
            clean = batch.filter(pc.invert(hit))
            counts.add(clean.column(len(keys)).to_pylist())
            yield rows(clean.filter(pc.match_substring_regex(clean.column(len(keys)), _runs())), "run")
            windows.add(clean.column(len(keys)).filter(pc.match_substring_regex(clean.column(len(keys)), "[^\\x00-\\x7f]")).to_pylist())
            if len(windows.counts) > HELD_WINDOWS:
                yield passed_on()
    yield passed_on()
    yield rows(None, "count", ([3], [0], [total]))
    for n, at, count in counts.rows():
        for k in range(0, len(at), 20_000):
            part = slice(k, k + 20_000)
            yield rows(None, "count", ([n] * len(at[part]), at[part], count[part]))


class Held(dict):
    """What was found for short texts; when it is too much, it begins anew."""

    size = 0

    def keep(self, text: str, found: dict) -> None:
        if len(text) > LONGEST_HELD:
            return
        if self.size >= HELD_PIECES:
            self.clear()
            self.size = 0
        self.size += 1 + len(found)
        self[text] = found


class Repairer:
    """Undoes wrong decodings by the characters of `alphabet`, judged by `model`.

    A span must gain more than `margin`; a word undone by a pair of charsets more than `run_margin` for each letter.
    """

    def __init__(self, model: Model, alphabet: set[str], margin: float = LEAST_MARGIN, run_margin: float = LEAST_RUN_MARGIN):
        self.model, self.margin, self.run_margin = model, margin, run_margin
        self.common = sorted(alphabet, key=lambda c: -model.ones.get(ord(c), 0))
        self.known = {c: self._reverse(c, set(alphabet)) for c in CHARSETS}
        self.bytes = {c: self._reverse(c, set(_table(c)) | alphabet) for c in {b for pair in TWICE for b in pair}}
        self.shapes = {c: re.compile(f"(?:{_shape(c)})+") for c in CHARSETS}
        self.units = {c: re.compile(_shape(c)) for c in CHARSETS}
        self.leads = {c: frozenset(_table(c)[0xC2 - 0x80 : 0xF5 - 0x80]) for c in CHARSETS}
        self.swapped = re.compile(SWAPPED)
        letter = f"[{re.escape(_upper())}]"
        self.run = re.compile(f"{letter}{letter}{{{RUN - 1},}}")  # a set first, which is looked for faster than a repeated one
        self.pieces, self.words = Held(), Held()
        seen = {c for c in alphabet if model.ones.get(ord(c), 0) > 1}
        upper = {c: _table(c) for c in CHARSETS}
        of = {c: {x for x in t if x.isalpha()} for c, t in upper.items()}
        self.pairs = {
            (a, b): {y: x for x, y in zip(upper[a], upper[b], strict=True) if y.isalpha() and x.isalpha() and x in seen}
            for a in CHARSETS if len(of[a] & seen) >= SCRIPT_LETTERS for b in CHARSETS if a != b and of[a] != of[b]
        }

    def _reverse(self, charset: str, alphabet: set[str]) -> dict[str, str]:
        """What each garbled character was; where a lost byte leaves several, the most frequent one."""
        t, lost = _table(charset), _undefined(charset)
        out: dict[str, str] = {}
        order = [c for c in self.common if c in alphabet] + sorted(alphabet - set(self.common))
        for c in order:
            raw = c.encode("utf-8", "ignore")
            if len(raw) < 2:
                continue
            out.setdefault("".join(t[b - 0x80] for b in raw), c)
        for c in order:
            raw = c.encode("utf-8", "ignore")
            if len(raw) > 1 and any(b in lost for b in raw):
                for mark in LOST:
                    out.setdefault("".join(mark if b in lost else t[b - 0x80] for b in raw), c)
        return out

    def _undo(self, text: str, charset: str, table: dict[str, str]) -> list[tuple[int, int, str]]:
        """Spans of `text` that decode, with what they become."""
        spans = []
        if self.leads[charset].isdisjoint(text):
            return spans
        for m in self.shapes[charset].finditer(text):
            at, start, got = m.start(), None, []
            while at < m.end():
                unit = next((n for n in (3, 2, 4) if text[at : at + n] in table and at + n <= m.end()), 0)
                if unit:
                    start = at if start is None else start
                    got.append(table[text[at : at + unit]])
                    at += unit
                    continue
                if got:
                    spans.append((start, at, "".join(got)))
                    start, got = None, []
                at += 1
            if got:
                spans.append((start, at, "".join(got)))
        return spans

    def _of_word(self, word: str) -> dict[int, str]:
        """What each pair of charsets that decodes a run of letters makes of it, by the pair's number."""
        out = self.words.get(word)
        if out is None:
            letters, out = set(word), {}
            for k, table in enumerate(self.pairs.values()):
                if table.keys() >= letters and (got := "".join(table[c] for c in word)) != word:
                    out[k] = got
            self.words.keep(word, out)
        return out

    def read_as(self, text: str) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
        """Every pair of charsets that decodes some words of `text`, with the words' runs of letters that change."""
        places = [(*m.span(), got) for m in self.run.finditer(text) if (got := self._of_word(m.group()))]
        kinds = {k for *_, got in places for k in got}
        for k, names in enumerate(self.pairs) if kinds else ():
            if k in kinds:
                yield " as ".join(names), [(start, end, got[k]) for start, end, got in places if k in got]

    def _of_piece(self, piece: str) -> dict[int, list[tuple[int, int, str]]]:
        """The spans of a piece that each chain changes, by the chain's number, 0 for UTF-16."""
        out = self.pieces.get(piece)
        if out is None:
            out = {}
            if spans := [(m.start(), m.end(), "".join(chr(ord(c) >> 8) for c in m.group())) for m in self.swapped.finditer(piece)]:
                out[0] = spans
            out |= {k: spans for k, names in enumerate(CHAINS, 1) if (spans := self.undone(piece, *names))}
            self.pieces.keep(piece, out)
        return out

    def candidates(self, text: str) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
        """Every chain over UTF-8 or UTF-16 that decodes some of `text`, with the spans that change."""
        places = [(m.start(), got) for m in PIECE.finditer(text) if m.end() - m.start() > 1 and (got := self._of_piece(m.group()))]
        for k in sorted({k for _, got in places for k in got}):
            names = CHAINS[k - 1]
            name = "utf-16 swapped" if k == 0 else f"utf-8 as {names[0]}" + (f", twice as {names[1]}" if names[1:] else "")
            yield name, [(at + a, at + b, x) for at, got in places for a, b, x in got.get(k, ())]

    def undone(self, text: str, first: str, second: str | None = None) -> list[tuple[int, int, str]]:
        """The spans of `text` that change when it is taken for UTF-8 read as `first`, and that as `second`."""
        if second is None:
            return self._undo(text, first, self.known[first])
        spans = []
        for a, b, got in self._undo(text, second, self.bytes[second]):
            inner = self._undo(got, first, self.known[first])
            if inner:
                out, at = [], 0
                for i, j, s in inner:
                    out += [got[at:i], s]
                    at = j
                spans.append((a, b, "".join([*out, got[at:]])))
        return spans

    def gains(self, text: str, spans: list[tuple[int, int, str]], apart: bool = False) -> list[float]:
        """How much likelier each span becomes, with two characters of context on both sides. With `apart`, the model is to forget this text."""
        each: dict[str, int] = {}
        pairs = []
        for a, b, got in spans:
            left, right = text[max(0, a - 2) : a].rjust(2, "\n"), text[b : b + 2]
            pairs += [each.setdefault(left + x + right, len(each)) for x in (got, text[a:b])]
        scores = self.model.scores(list(each), text if apart else None)[pairs]
        return (scores[::2] - scores[1::2]).tolist()

    def gained(self, text: str, found: Iterable[tuple[str, list[tuple[int, int, str]]]], apart: bool) -> Iterator[tuple[str, list[tuple[int, int, str]], list[float]]]:
        """Names and spans as they are found, with the spans' `gains`, which are told together for up to `SCORED` characters."""
        held: list[tuple[str, list[tuple[int, int, str]]]] = []
        size = 0
        for x in itertools.chain(found, [None]):
            if x is not None:
                held.append(x)
                size += sum(b - a for a, b, _ in x[1])
            if held and (x is None or size > SCORED):
                gains = self.gains(text, [s for _, spans in held for s in spans], apart)
                at = 0
                for name, spans in held:
                    yield name, spans, gains[at : at + len(spans)]
                    at += len(spans)
                held, size = [], 0

    def best(self, text: str) -> tuple[str, list[tuple[int, int, str]], float] | None:
        """The chain with the greatest total gain, its accepted spans, and that gain; pairs of charsets where no chain over Unicode is accepted."""
        top = None
        for found, least in ((self.candidates(text), None), (self.read_as(text), self.run_margin)):
            for name, spans, gains in self.gained(text, found, least is not None):
                fit = [(s, g) for s, g in zip(spans, gains, strict=True) if g > (self.margin if least is None else max(self.margin, least * (s[1] - s[0])))]
                total = sum(g for _, g in fit)
                if fit and (top is None or total > top[2]):
                    top = (name, [s for s, _ in fit], total)
            if top:
                break
        return top

    def repair(self, text: str) -> tuple[str, list[str], float]:
        """The text with all accepted spans replaced, the chains, and the gain."""
        chains, gain = [], 0.0
        for _ in range(4):
            found = self.best(text)
            if found is None:
                break
            chain, spans, more = found
            parts, at = [], 0
            for a, b, got in spans:
                parts += [text[at:a], got]
                at = b
            text = "".join([*parts, text[at:]])
            chains.append(chain)
            gain += more
        return text, chains, gain


def _garbled(text: str, first: str, second: str | None = None) -> str:
    """`text` as its UTF-8 bytes look when read as `first`, and once more as `second`."""
    t = _table(first)
    bad = "".join(t[b - 0x80] if b > 0x7F else chr(b) for b in text.encode("utf-8", "replace"))
    return _garbled(bad, second) if second else bad


def _units(repairer: Repairer, c: str) -> list[tuple[str, int, int, str, tuple[str, ...]]]:
    """What each chain makes of a character, and the span of it that decodes to a single character."""
    out = []
    for names in CHAINS:
        bad = _garbled(c, *names)
        out += [(bad, a, b, got, names) for a, b, got in repairer.undone(bad, *names) if len(got) == 1]
    return out


def _window_gains(repairer: Repairer, windows: list[str], counts: list[int], units: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """How much the single characters of clean texts gain that every chain garbled, and how often.

    Once alone in clean text, once in a text that is garbled all over, if what stands beside it is no part of the span then.
    `units` keeps `_units` of each character.
    """
    pairs: Counter[tuple[str, str]] = Counter()
    for w, n in zip(windows, counts, strict=True):
        left, c, right = w[:2], w[2], w[3:]
        if c not in units:
            units[c] = _units(repairer, c)
        apart, plain = (left[1] + right[0]).isascii(), (left + right).isascii()
        for bad, a, b, got, names in units[c]:
            before, after = (left + bad[:a])[-2:], (bad[b:] + right)[:2]
            pairs[before + got + after, before + bad[a:b] + after] += n * (2 if plain else 1)
            if apart and not plain:
                before, after = (_garbled(left, *names) + bad[:a])[-2:], (bad[b:] + _garbled(right, *names))[:2]
                pairs[before + got + after, before + bad[a:b] + after] += n
    each = list(pairs)
    return np.subtract(*(repairer.model.scores([p[k] for p in each]) for k in (0, 1))), np.array(list(pairs.values()), np.int64)


def _word_gains(repairer: Repairer, text: str) -> tuple[list[float], list[float]]:
    """What the clean words of a text gain by the letter, under each pair of charsets; and the same words read wrongly."""
    clean, wrong = [], []
    for name, spans, gains in repairer.gained(text, repairer.read_as(text), True):
        own, other = name.split(" as ")
        back = {x: y for x, y in zip(_table(other), _table(own), strict=True)}  # the clean word written in `other`, read as `own`
        for (a, b, _), g in zip(spans, gains, strict=True):
            clean.append(g / (b - a))
            left, right = text[max(0, a - 2) : a].rjust(2, "\n"), text[b : b + 2]
            wrong.append((left + text[a:b] + right, left + "".join(back.get(c, c) for c in text[a:b]) + right, b - a))
    if not wrong:
        return [], []
    by_letter = np.subtract(*(repairer.model.scores([w[k] for w in wrong]) for k in (0, 1))) / np.array([w[2] for w in wrong])
    return clean, by_letter.tolist()


def _counted(kind: int, gains: np.ndarray, counts: np.ndarray, up: bool = False) -> pa.RecordBatch:
    """Counts by gain, in steps; what a step holds counts as its lower end, with `up` as its upper one."""
    step = np.clip((np.ceil if up else np.floor)(np.asarray(gains, np.float64) * STEPS), -LARGEST * STEPS, LARGEST * STEPS).astype(np.int32)
    kinds, which = np.unique(step, return_inverse=True)
    total = np.bincount(which, counts, len(kinds)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(kinds), pa.int32()), pa.array(kinds), pa.array(total)], ["kind", "step", "count"])


def _at(steps: np.ndarray, counts: np.ndarray, share: float, most: bool = False) -> float:
    """The gain that `share` of all are below (with `most`, above); the least (largest) if that is less than one."""
    order = np.argsort(-steps if most else steps)
    return float(steps[order][np.searchsorted(np.cumsum(counts[order]), int(share * counts.sum()), side="right")]) / STEPS


def _margins(clean: DataFrame, runs: DataFrame, held, odds: float) -> tuple[float, float]:
    """The margins, from all clean rows: `clean` holds their `Windows` (`text`, `count`), `runs` the texts with letters of the charsets in a row
    among the rows that the pattern doesn't have (others may have been read wrongly themselves).

    A span must gain the logarithm of the `odds` against a row's being garbled, and of the number of chains that are
    tried; validated by the clean rows: at most half of what all but `HARDER` of the garbled spans gain. A word must gain for
    each letter more than all but `HARDER` of the clean ones do under any pair, halfway to nearly all of the wrongly read ones.
    `held` is a broadcast model and alphabet.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, units = Repairer(*held.value), {}
        for batch in batches:
            windows, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(windows), SCORED_WINDOWS):
                yield _counted(0, *_window_gains(own, windows[k : k + SCORED_WINDOWS], counts[k : k + SCORED_WINDOWS], units))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Repairer(*held.value)
        for batch in batches:
            both = [_word_gains(own, t) for t in batch.column(0).to_pylist()]
            for kind in (1, 2):
                gains = np.array([g for x in both for g in x[kind - 1]])
                yield _counted(kind, gains, np.ones(len(gains)), kind == 1)

    shape = "kind int, step int, count bigint"
    # By work, not bytes: adaptive execution would put them together in one task.
    clean = clean.repartition(max(int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")), clean.sparkSession.sparkContext.defaultParallelism), "text")
    gained = clean.groupBy("text").agg(F.sum("count").alias("count")).mapInArrow(spans, shape).unionByName(runs.select("text").mapInArrow(words, shape))
    got = gained.groupBy("kind", "step").agg(F.sum("count").alias("count")).toArrow()
    kind, step, count = (got[c].to_numpy() for c in ("kind", "step", "count"))
    of = [(step[kind == k], count[kind == k]) for k in range(3)]
    margin = max(LEAST_MARGIN, min([odds + float(np.log(len(CHAINS))), *([_at(*of[0], HARDER) / 2] if len(of[0][0]) else [])]))
    low = _at(*of[2], 0.05) if len(of[2][0]) else LEAST_RUN_MARGIN
    most = max(0.0, _at(*of[1], HARDER, True)) if len(of[1][0]) else 0.0
    return margin, max(LEAST_RUN_MARGIN, (low + most) / 2 if low > most else most + LEAST_RUN_MARGIN)


_BROKEN = re.compile("[\x80-\x9f\ufffd]")


def _alphabet(counts: Counts) -> set[str]:
    seen = np.flatnonzero(counts.one[0xA0:] > 1) + 0xA0
    return {chr(x) for x in seen if not 0xD800 <= x < 0xE000} | set(COMMON)


def find_garbled(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The rows whose text, or any part of it, is garbled: `keys`, `restored`, `chain`, `gain`.

    `restored` is the whole text with HTML references resolved and every accepted span decoded; null where characters
    are lost for good (U+FFFD stays, or a span had a lost byte). Null and empty texts are never cases. Repeated rows are
    judged alike. An alphabet is learnt from the clean rows, so a corpus without any can only be judged by `COMMON`.
    Words with fewer than `RUN` letters beyond ASCII in a row are not undone by pairs of charsets: a single other accent
    is too little to tell.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    types = [arrow[k] for k in kinds]
    shape = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True))
    parts = stage(
        df.select(*keys, F.col(text_col).cast("string").alias("text")).mapInArrow(
            lambda batches: _split(batches, keys, types), f"{shape}, text string, n int, key bigint, count bigint, kind string"
        ),
        "garbled", by=["kind"],
    )
    hits = parts.where("kind = 'hit'").select(*keys, "text")
    judged = parts.where("kind in ('hit', 'run')").select(*keys, "text")
    counts = gather(parts.where("kind = 'count'").select("n", "key", "count"))
    first = df.sparkSession.sparkContext.broadcast((Model(counts), _alphabet(counts)))

    def also_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, more, windows = Repairer(*first.value), Counts(), Windows()

        def rows(*columns) -> pa.RecordBatch:
            number = [pa.array(x, t) for x, (_, t) in zip(columns, COUNT_FIELDS, strict=False)]
            return pa.RecordBatch.from_arrays([*number, pa.array(columns[3], pa.string())], [*(n for n, _ in COUNT_FIELDS), "text"])

        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if not _BROKEN.search(t) and next(own.candidates(t), None) is None]
            more.add(texts)
            windows.add(texts)
            if len(windows.counts) > HELD_WINDOWS:
                some, count = windows.taken()
                yield rows([4] * len(some), [None] * len(some), count, some)
        some, count = windows.taken()
        yield rows([4] * len(some), [None] * len(some), count, some)
        for n, at, count in more.rows():
            yield rows([n] * len(at), at, count, [None] * len(at))

    added = stage(hits.select("text").mapInArrow(also_clean, "n int, key bigint, count bigint, text string"), "also_clean")
    counts = counts + gather(added.where("n < 3").drop("text"))
    rows = parts.where("kind = 'count' and n = 3").agg(F.sum("count")).first()[0] or 0
    odds = float(np.log((rows + 1) / (hits.count() + 1)))
    held = df.sparkSession.sparkContext.broadcast((Model(counts), _alphabet(counts)))
    windows = parts.where("kind = 'window'").select("text", "count").unionByName(added.where("n = 4").select("text", "count"))
    margins = _margins(windows, parts.where("kind = 'run'"), held, odds)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Repairer(*held.value, *margins)
        for batch in batches:
            out: list[tuple] = []
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                restored, chains, gain = own.repair(text)
                if chains or "�" in text:
                    lost = "�" in restored or any(m in text and restored.count(m) < text.count(m) for m in LOST)
                    out.append((k, None if lost else restored, " then ".join(chains) or None, gain))
            rows = [list(x) for x in zip(*out, strict=True)] or [[], [], [], []]
            take = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in range(len(keys))), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.float64())],
                [*keys, "restored", "chain", "gain"],
            )

    return judged.mapInArrow(judge, f"{shape}, restored string, chain string, gain double")
