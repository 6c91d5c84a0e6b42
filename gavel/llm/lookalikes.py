"""One consistent form for text that looks the same but is written with different characters.

Look-alike classes are the connected groups of pairs (a character or string, and what it looks like): styled forms and
ligatures, sequences of a letter and marks that exist as one character, and letters of other scripts by `LETTERS`. So a
full-width, a mathematical and a Cyrillic a are all in the class of the Latin one. A class is represented by the member
whose script or style is the most frequent in the corpus, of equals by the one that is itself (the parts of a sequence
are counted as characters, so a sequence itself never represents). Rewriting replaces, from left to right and longest
first, every member by its representative with one automaton over all of them, which also takes out invisible characters
and makes odd spaces plain. Letters of other scripts are replaced only in words without a letter that has no Latin
look-alike. Marks that follow what was replaced are composed last.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.charmodel import STEP, points
from gavel.sources.staging import stage

#: Letters of other scripts and the Latin letters they look like (fixed values), in pairs.
LETTERS = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "ү": "y",
    # Greek
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "հ": "h", "ո": "n", "օ": "o", "ս": "u", "զ": "q", "ց": "g", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    # Cherokee and Lisu capitals
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮖ": "I", "Ꮤ": "W", "Ꮪ": "S", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ꮩ": "V", "Ꮮ": "L", "Ᏼ": "B",
}
#: Kinds of compatibility form that are another look of a letter or digit (fixed values of the Unicode tables).
STYLES = ("<font>", "<wide>", "<narrow>", "<circle>")
#: Ligatures, and letters written as one character that stand for several (fixed values).
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆﬓﬔﬕﬖﬗĳĲŀĿŉſ"
#: Format characters that are seen, or that belong to the script they stand in (fixed values).
SEEN = set(range(0x600, 0x606)) | {0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
JOINERS = "‌‍"


@cache
def styled() -> dict[str, str]:
    """Every styled letter or digit, and its plain form."""
    out = {c: unicodedata.normalize("NFKC", c) for c in LIGATURES}
    for x in [*range(0xA0, 0xD800), *range(0xF900, 0x1F200)]:
        c = chr(x)
        if unicodedata.decomposition(c).startswith(STYLES):
            plain = unicodedata.normalize("NFKC", c)
            if plain.isalnum() and plain != c:
                out[c] = plain
    return out


@cache
def invisible() -> str:
    """Characters that aren't seen: format and control characters, and fillers."""
    special = {0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5}
    return "".join(
        chr(x)
        for x in range(0xE0080)
        if x not in SEEN and not 0xD800 <= x < 0xE000
        and (unicodedata.category(chr(x)) == "Cf" or x in special or unicodedata.category(chr(x)) == "Cc" and x not in (9, 10, 11, 12, 13, 0x85))
    )


@cache
def odd_spaces() -> str:
    return "".join(chr(x) for x in range(0x3001) if unicodedata.category(chr(x)) == "Zs" and x != 0x20)


@cache
def marks() -> str:
    """Combining marks that take part in some composition."""
    out = set()
    for x in range(0xC0, 0x1F200):
        parts = unicodedata.decomposition(chr(x)).split() if not 0xD800 <= x < 0xE000 else []
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(x)) == chr(x):
            out.add(chr(int(parts[1], 16)))
    return "".join(sorted(c for c in out if unicodedata.combining(c)))


@cache
def sequences() -> dict[str, str]:
    """Every sequence of a letter and marks that exists as one character, and that character: fully and by its last mark only."""
    out = {}
    for x in range(0xC0, 0x1F200):
        c = chr(x)
        parts = unicodedata.decomposition(c).split() if not 0xD800 <= x < 0xE000 else []
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            for s in ("".join(chr(int(h, 16)) for h in parts), unicodedata.normalize("NFD", c)):
                if all(map(unicodedata.combining, s[1:])):
                    out[s] = c
    return out


def union(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """The number of each string's class: strings are in one class if pairs link them, however indirectly."""
    parent: dict[str, str] = {}

    def find(s: str) -> str:
        while parent.setdefault(s, s) != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for a, b in pairs:
        parent[find(a)] = find(b)
    numbers: dict[str, int] = {}
    return {s: numbers.setdefault(find(s), len(numbers)) for s in parent}


def representatives(pairs: list[tuple[str, str]], frequency: Callable[[str], tuple[int, ...]]) -> dict[str, str]:
    """Every string of a class with its representative: the one of the greatest frequency, of equals the first in code point order."""
    classes: dict[int, list[str]] = {}
    for s, k in union(pairs).items():
        classes.setdefault(k, []).append(s)
    out = {}
    for members in classes.values():
        best = min(sorted(members), key=lambda s: tuple(-n for n in frequency(s)))
        out.update({s: best for s in members})
    return out


def _joining(c: str) -> bool:
    """Whether joiners belong to the spelling of words with this character: Indic and Arabic scripts."""
    return "؀" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" or "ऀ" <= c <= "෿"


class Rewriter:
    """Brings texts to one form; `frequency` counts the characters of the corpus."""

    def __init__(self, frequency: dict[str, int]):
        pairs = [*LETTERS.items(), *styled().items(), *sequences().items()]
        # Whole scripts and styles are counted: one rare letter doesn't change its script.
        totals: dict[str, int] = {}
        for c in {c for pair in pairs for c in pair if len(c) == 1}:
            totals[_script(c)] = totals.get(_script(c), 0) + frequency.get(c, 0)
        composed = sequences()

        def how_often(s: str) -> tuple[int, ...]:
            if s in composed:
                return -1, -1
            return max(totals.get(_script(c), 0) for c in s), max(frequency.get(c, 0) for c in s)

        self.forms = representatives(pairs, how_often)
        patterns = {s: to for s, to in self.forms.items() if s != to and (s in LETTERS or s in styled() or s in composed)}
        patterns.update({c: " " for c in odd_spaces()})
        patterns.update({c: "" for c in invisible()})
        self.machine = ahocorasick.Automaton()
        for s, to in patterns.items():
            self.machine.add_word(s, (s, to))
        self.machine.make_automaton()
        self.composable = re.compile(f"(?s:.)[{re.escape(marks())}]+")
        self.word = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ​-‍⁠﻿\xad])*")

    def _stays(self, text: str, at: int) -> bool:
        """Whether an invisible character belongs to its place: a joiner inside a word, or in or after an emoji."""
        c, before, after = text[at], text[at - 1 : at], text[at + 1 : at + 2]
        if c in JOINERS:
            if before and after and _joining(before) and _joining(after):
                return True
            return c == "‍" and bool(before) and (unicodedata.category(before) == "So" or before in "️\U0001f3fb\U0001f3fc\U0001f3fd\U0001f3fe\U0001f3ff")
        return 0xE0020 <= ord(c) <= 0xE007F and bool(before) and (unicodedata.category(before) == "So" or 0xE0020 <= ord(before) <= 0xE007F)

    def _compose(self, m: re.Match) -> str:
        made = unicodedata.normalize("NFC", m.group())
        return made if len(made) < len(m.group()) else m.group()

    def _lookalike(self, word: str) -> bool:
        """Whether every letter of a word is Latin or looks like a Latin letter."""
        return all(not c.isalpha() or _latin(c) or c in LETTERS or all(map(_latin, styled().get(c, c))) for c in word)

    def rewrite(self, text: str) -> str:
        out, at, fits, words = [], 0, True, None
        word = (0, 0)
        for end, (s, to) in self.machine.iter_long(text):
            start = end - len(s) + 1
            if to == "" and self._stays(text, start):
                continue
            if s in LETTERS:
                words = words or (m.span() for m in self.word.finditer(text))
                if start >= word[1]:  # another word than the last one looked at
                    word = next(w for w in words if w[1] > start)
                    fits = self._lookalike(text[slice(*word)])
                if not fits:
                    continue
            out += [text[at:start], to]
            at = end + 1
        text = "".join([*out, text[at:]])
        return self.composable.sub(self._compose, text)


@cache
def _script(c: str) -> str:
    """The script or style of a letter or digit, by its name; ASCII characters are one."""
    return "" if c.isascii() else unicodedata.name(c, "?").split()[0]


@cache
def _latin(c: str) -> bool:
    return c.isascii() or unicodedata.name(c, "").startswith("LATIN ")


def _prefilter() -> str:
    q = lambda c: f"\\x{{{ord(c):x}}}"
    codes = sorted({*map(ord, styled()), *map(ord, invisible()), *map(ord, odd_spaces()), *map(ord, marks()), *map(ord, LETTERS)})
    # A nukta or vowel sign is in most Hindi words, so only the letters that compose with it count.
    codes = [x for x in codes if not 0x900 <= x < 0xE00]
    ranges, start = [], None
    for a, b in zip(codes, [*codes[1:], -1], strict=True):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(q(chr(start)) + ("-" + q(chr(a)) if a > start else ""))
            start = None
    indic = sorted({(p[0], p[1]) for x in range(0x900, 0xE00) if len(p := unicodedata.decomposition(chr(x)).split()) == 2 and unicodedata.normalize("NFC", chr(x)) == chr(x)})
    pairs = "|".join(q(chr(int(a, 16))) + q(chr(int(b, 16))) for a, b in indic)
    return f"[{''.join(ranges)}]" + (f"|{pairs}" if pairs else "")


#: The joiners of Hindi spelling, between two Devanagari characters.
_USUAL = "([\\x{900}-\\x{97f}])[\\x{200c}\\x{200d}]([\\x{900}-\\x{97f}])"


def normalised(df: DataFrame, keys: list[str], text_col: str, changed_only: bool = True) -> DataFrame:
    """`keys` and `normal`, the text in its one form; with `changed_only`, the rows whose text differs from it.

    Null texts have a null form, empty ones an empty one; both never count as changed. Joiners inside words of Indic
    and Arabic scripts stay, as do words with a letter that has no Latin look-alike, typographic punctuation,
    fractions and superscripts. The representatives depend on the frequencies of all given texts.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    types, n = [arrow[k] for k in kinds], len(keys)
    shape = ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, total = _prefilter(), np.zeros(0x110000, np.int64)
        names = [*keys, "text", "point", "count", "kind"]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = batch.column(n)
                joined = "".join(t for t in texts.to_pylist() if t)
                for k in range(0, len(joined), STEP):
                    some = np.bincount(points(joined[k : k + STEP]))
                    total[: len(some)] += some
                usual = pc.replace_substring_regex(texts, _USUAL, "\\1\\2")
                hit = pc.fill_null(pc.match_substring_regex(usual, pattern), False)
                kept = batch if not changed_only else batch.filter(hit)
                m = kept.num_rows
                yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(n + 1)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(["text"] * m, pa.string())], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(at), t) for t in types), pa.nulls(len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(["count"] * len(at), pa.string())], names
        )

    parts = stage(
        df.select(*keys, F.col(text_col).cast("string").alias("text")).mapInArrow(split, f"{shape}, text string, point int, count bigint, kind string"),
        "lookalikes", by=["kind"],
    )
    counted = parts.where("kind = 'count'").groupBy("point").agg(F.sum("count").alias("n")).toArrow()
    frequency = {chr(x): n for x, n in zip(counted["point"].to_pylist(), counted["n"].to_pylist(), strict=True)}

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rewriter(frequency)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            forms = [None if t is None else own.rewrite(t) for t in texts]
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(forms, pa.string())], [*keys, "normal"])
            if changed_only:
                out = out.filter(pa.array([a != b for a, b in zip(texts, forms, strict=True)]))
            yield out

    return parts.where("kind = 'text'").select(*keys, "text").mapInArrow(rewrite, f"{shape}, normal string")
