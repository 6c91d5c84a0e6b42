"""HTML pages: text, turns and tables. Plain Python over the standard library, for Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

_TAG = re.compile(r"<[^>]*>")
_PARAGRAPH = re.compile(r"<p\b[^>]*>|</p>|<h[1-6]\b[^>]*>|<br\s*/?>", re.I)
_ANCHOR = re.compile(r'<a\s+name\s*=\s*"?(\d+)(?:\*(\d+))?"?\s*>', re.I)
_LABEL = re.compile(r"^\s*(?:<a[^>]*>\s*)*<b\b[^>]*>(.{1,200}?)\s*:?\s*</b>\s*:?", re.I | re.S)


def clean(markup: str | None) -> str | None:
    """The text of mark-up: tags out, references resolved, blanks collapsed inside paragraphs, one line each."""
    if markup is None:
        return None
    lines = (re.sub(r"\s+", " ", html.unescape(_TAG.sub(" ", part))).strip() for part in _PARAGRAPH.split(markup))
    return "\n".join(line for line in lines if line)


def looks_old(markup: str) -> bool:
    """Whether a page has no anchor with a part number: the older form."""
    return not re.search(r'<a\s+name\s*=\s*"?\d+\*\d+', markup, re.I)


def turns(markup: str | None) -> list[tuple[int, str | None, str | None, str]]:
    """The turns of a page: number, code of the anchor, label, text.

    A paragraph with a bold label before a colon, or with an anchor, begins a turn; others go on with the one before.
    Paragraphs before the first turn are a turn without label. Never-closed anchors and paragraphs are fine.
    """
    out: list[tuple[int, str | None, str | None, str]] = []
    for part in re.split(r"<p\b[^>]*>|<h[1-6]\b[^>]*>", markup or "", flags=re.I):
        anchor, label = _ANCHOR.search(part), _LABEL.match(part)
        body = clean(part[label.end() :] if label else part) or ""
        if label or anchor:
            out.append((len(out), anchor.group(1) if anchor else None, clean(label.group(1)) if label else None, body))
        elif body and out:
            n, code, who, before = out[-1]
            out[-1] = (n, code, who, f"{before}\n{body}" if before else body)
        elif body:
            out.append((0, None, None, body))
    return out


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._close()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self._close()
            a = dict(attrs)
            number = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1
            self.cell, self.span = [], (number("rowspan"), number("colspan"))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is not None and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((re.sub(r"\s+", " ", "".join(self.cell)).strip(), *self.span))
        self.cell = None


def grids(markup: str | None) -> list[list[list[str]]]:
    """Every table as a grid in which cells that span rows or columns are repeated."""
    parser = _Tables()
    parser.feed(markup or "")
    parser.close()
    out = []
    for table in parser.tables:
        grid: list[list[str]] = []
        held: dict[int, tuple[str, int]] = {}
        for row in table:
            line: list[str] = []
            cells = list(row)
            while cells or len(line) in held:
                at = len(line)
                if at in held:
                    text, left = held.pop(at)
                    line.append(text)
                    if left > 1:
                        held[at] = (text, left - 1)
                    continue
                text, rows, columns = cells.pop(0)
                for k in range(columns):
                    if rows > 1:
                        held[len(line)] = (text, rows - 1)
                    line.append(text)
            grid.append(line)
        out.append(grid)
    return out


def to_latin(text: str) -> str:
    """Devanagari in Latin letters, by the letters' names: consonants carry a unless a sign or virama follows; no final a."""
    out: list[str] = []
    for k, c in enumerate(text):
        name = unicodedata.name(c, "")
        if not name.startswith("DEVANAGARI "):
            out.append(c)
            continue
        kind, _, sound = name.removeprefix("DEVANAGARI ").partition(" ")
        after = unicodedata.name(text[k + 1], "") if k + 1 < len(text) else ""
        if kind == "LETTER":
            sound = sound.lower().split()[-1]
            consonant = sound.endswith("a") and sound not in ("a", "aa")
            joined = "VOWEL SIGN" in after or "VIRAMA" in after or "NUKTA" in after
            last = consonant and not after.startswith("DEVANAGARI")
            out.append(sound[:-1] if consonant and (joined or last) else sound)
        elif "VOWEL SIGN" in name:
            out.append(name.rsplit(" ", 1)[-1].lower())
        elif kind == "DIGIT":
            out.append(str(unicodedata.digit(c)))
        elif "ANUSVARA" in name or "CANDRABINDU" in name:
            out.append("n")
        elif "VISARGA" in name:
            out.append("h")
        elif "DANDA" in name:
            out.append(".")
    return "".join(out)


def folded(name: str) -> str:
    """A spelling key: Latin letters, no accents, doubled letters and long vowels once, w as v, no h after a consonant."""
    t = unicodedata.normalize("NFD", to_latin(name).lower())
    t = re.sub(r"[^a-z ]", "", t)
    t = t.replace("ee", "i").replace("oo", "u").replace("w", "v")
    t = re.sub(r"(?<=[bcdfgjklmnpqrstvxz])h", "", t)
    return re.sub(r"(.)\1+", r"\1", t).strip()
