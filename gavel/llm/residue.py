"""Template residue, filler text and messages of the site in place of content.

Lists of syntaxes, phrases and openings are seeds: they say where to look and how much is believed before any row is
seen. What counts is decided by the rows.

*Placeholders.* Everything written like a template variable, a default or a blank is a marker: a syntax, a name, and the
words left and right of it. Records with the same words around a marker are aligned by them: such surroundings are a
slot where several names stand in them. A name is a variable where it stands in a slot, or in several syntaxes. A syntax
is a template's where enough of its names are variables (`SEED_MARKS` marks of each seeded syntax are believed to be);
then all it marks is residue. Of any other syntax, and of blanks and defaults, only what is a variable or stands in a
slot of variables.

*Filler.* Sentences of mock Latin are found by their two best-known words where no function word stands beside them;
the words of these sentences are the filler vocabulary, and any run of four of them anywhere is filler. Besides, a list
of phrases.

*Messages.* A page without its navigation lines is reduced to its skeleton (digits and paths masked), at any length. A
skeleton that pages fill in different ways is a whole-page template. An opening (the first words of the skeleton) is a
message's where enough of its pages are such templates: half if it begins like an error, access, sign-in, human-check or
script message, of which `SEED_PAGES` pages are believed to be; else nine in ten of those that name such a thing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators.relational import spread_lookup
from gavel.sources.staging import stage

_N = r"([A-Za-z][A-Za-z0-9]*(?:[_ .\-][A-Za-z0-9]+)*)"
#: Marker syntaxes: name, pattern, and whether it is seeded as one that only templates use.
SYNTAXES = [
    ("mustache", rf"\{{\{{\{{?\s*[#/^>&]?\s*{_N}\s*(?:\|[^{{}}]*)?\}}?\}}\}}", True),
    ("dollar", rf"\$\{{\s*{_N}[^{{}}]*\}}", True),
    ("hash", rf"#\{{\s*{_N}\s*\}}", True),
    ("double bracket", r"\[\[\s*([A-Za-z]*(?:[A-Z]{3,}|[A-Za-z0-9]_)[A-Za-z0-9_]*)\s*\]\]", True),
    ("percent", r"%([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*)%", True),
    ("format", rf"%\({_N}\)[sdif]", True),
    ("embedded", rf"<%[=\-]?\s*{_N}\s*-?%>", True),
    ("block", rf"\{{%-?\s*(?:block|if|for|include|set)\s+{_N}[^%]*%\}}", True),
    ("underscores", r"(?<![A-Za-z0-9_])__([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*)__(?![A-Za-z0-9_])", True),
    ("at signs", r"@@([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*)@@", True),
    ("insert", rf"(?i)[<\[]\s*(?:insert|enter|fill in|type|your)\s+(?:the\s+|your\s+)?{_N}(?<! here)(?:\s+here)?\s*[>\]]", True),
    ("insert in Hindi", r"\[([^\[\]]{0,40}?)\s*(?:लिखें|भरें|डालें|जोड़ें)\]", True),
    ("quotation", rf"«{_N}»", False),
    ("brace", rf"(?<![{{$#%(]){{{_N}}}(?!}})", False),
    ("bracket", rf"(?<!\[)\[{_N}\](?!\])", False),
    ("angle", r"<([A-Za-z]+(?:_[A-Za-z]+)+)>", False),
    ("blank", r"(_{3,}|\.{5,})", False),
    ("default", r"(?i)\b(TBD|TBC|dd[/-]mm[/-]yy(?:yy)?|xx+)\b", False),
]
_syntaxes = [(name, re.compile(p), strong) for name, p, strong in SYNTAXES]
_ANY_MARKER = "_{3}|\\.{5}|(?i:\\bTBD\\b|\\bTBC\\b|dd[/-]mm[/-]yy|\\bxx+\\b)|\\{\\{|\\$\\{|#\\{|\\[\\[|<%|\\{%|__[A-Za-z]|@@|%\\(|%[A-Za-z]|«[A-Za-z]|\\{[A-Za-z]|<[A-Za-z]+[ _]|\\[[A-Za-z]|(लिखें|भरें|डालें|जोड़ें)\\]"
#: Filler phrases at the start of a sentence (fixed values).
FILLER = (
    r"this is (?:a )?(?:dummy|sample|placeholder|filler|test) (?:content|text|paragraph|page)",
    r"(?:sample|dummy|placeholder|filler) (?:text|content)\b.{0,40}(?:goes )?here",
    r"(?:sub)?(?:heading|title|caption|text|content|body copy|body text|description|summary) goes here",
    r"content (?:is )?coming soon", r"text to be (?:supplied|added|inserted|provided)", r"(?:type|enter|write) your \w+ (?:in this box|here)",
    r"(?:test ){3,}", r"(?:asdf ?){2,}", r"यहाँ नमूना पाठ", r"नमूना पाठ यहाँ", r"lorem ipsum dolor sit",
)
_filler = re.compile(r"(?:^|[.!?।>…]|\n)\s*(?:" + "|".join(FILLER) + ")", re.I)
_ANY_FILLER = "(?i)goes here|coming soon|dummy|sample |placeholder|filler|to be (supplied|added|inserted|provided)|(type|enter|write) your|asdf|test test|नमूना|lorem|ipsum"
SEEDS = {"lorem", "ipsum"}
#: Words that a sentence of real English has (fixed values).
FUNCTION = set("the a an of in on at to for from by with and or but is are was were be been has have had it its this that which who not no as than said he she they we you i his her their our".split())
#: What messages are about, and how they begin.
_ANY_SIGNAL = "(?i)error|denied|forbidden|not found|unavailable|unauthori[sz]ed|javascript|script|cookies|sign in|log in|login|session|human|robot|captcha|puzzle|too many|time-?out|timed out|traceback|fatal|exception|oops|went wrong|permission|bad gateway|क्षमा|त्रुटि|जावास्क्रिप्ट|साइन इन|लॉग इन|पृष्ठ"
_OPENING = re.compile(
    r"""(?isx)^\s*(?:
    (?:http\s*|error\s*:?\s*|status\s*)?[45]\d\d\b\s*[-–:|]?\s*(?:\(|page\ not|not\ found|forbidden|internal|bad|service|gateway|unauthori|access|error|too\ many|moved)
    |<html[^>]*>.{0,200}<title>[^<]{0,40}(?:[45]\d\d|error|forbidden|not\ found|denied|unavailable)
    |error\s+[45]\d\d\b
    |(?:access|permission)\ (?:is\ )?denied|forbidden\b|unauthori[sz]ed\b|service\ (?:is\ )?(?:temporarily\ )?unavailable|bad\ gateway|gateway\ time-?out|internal\ server\ error
    |(?:the\ )?(?:page|file|document)\ (?:you\ (?:asked|requested|are\ looking)\b.{0,40}|could\ |was\ |is\ )?(?:not\ (?:be\ )?(?:found|available|on\ this\ server)|cannot)
    |too\ many\ requests|request\ timed\ out|fatal\ error|uncaught\ |unhandled\ |traceback\ \(most|warning:\ \w+\(|exception\ in\ 
    |oops|sorry,?\ (?:but\ )?(?:this|the|that|we|something)\b|something\ went\ wrong|we(?:'|’)?re\ sorry
    |(?:your\ )?session\ (?:has\ )?(?:expired|timed\ out)|please\ (?:sign|log)\ ?in\b|(?:sign|log)\ in\ to\b|you\ (?:must|need\ to|have\ to)\ (?:be\ )?(?:sign|log)
    |(?:please\ )?(?:enable|turn\ on|allow|activate)\ (?:javascript|java\ script|scripts|cookies)|you\ (?:must|need\ to|have\ to)\ (?:enable|turn\ on|allow)
    |this\ (?:page|site|app|application|viewer)\ (?:needs|requires|uses)\ (?:javascript|scripts?)|javascript\ (?:is|must|has)\b|scripts?\ (?:is|are|must)\ 
    |loading\b.{0,80}(?:allow|enable|turn\ on)\ (?:scripts|javascript)
    |<noscript>
    |(?:please\ )?(?:verify|confirm|prove)\ (?:that\ )?you\ are|are\ you\ (?:a\ )?(?:human|robot)|checking\ (?:your|if)|(?:solve|complete)\ the\ (?:puzzle|captcha)|unusual\ traffic
    |क्षमा\ करें|त्रुटि\b|पृष्ठ\ (?:नहीं|उपलब्ध)|यह\ पृष्ठ\ (?:नहीं|उपलब्ध)|(?:कृपया\ )?(?:साइन|लॉग)\ ?इन\ करें|[^।\n]{0,60}जावास्क्रिप्ट\ (?:चालू|सक्षम|सक्रिय)\ करें
    )"""
)
_signal = re.compile(_ANY_SIGNAL)
#: Lines of navigation around a page's text.
_chrome = re.compile(r"^\s*(?:[^|\n]{1,40}(?:\|[^|\n]{1,40})+|©.*|\[\d+\]|(?:copyright|all rights reserved)\b.*)\s*$", re.I)
#: Marks of a seeded syntax, and pages of a seeded opening, that are believed to be a template's before any is seen.
SEED_MARKS, SEED_PAGES = 8, 8
#: Words of an opening; the shares of template pages that make an opening a message's, seeded or not.
OPENING_WORDS, SEEDED_SHARE, OTHER_SHARE = 3, 0.5, 0.9
#: Places of the table of filler words by hash, and the words in a row that make a run of filler.
WORD_HASHES, RUN_WORDS = 1 << 16, 4


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def core_of(text: str) -> str:
    """A page without navigation lines and a trailing number in brackets."""
    lines = [line for line in text.splitlines() if line.strip() and not _chrome.match(line)]
    return re.sub(r"\s*\[\d+\]\s*$", "", "\n".join(lines)).strip()


def _sentences(text: str) -> list[list[str]]:
    return [re.findall(r"[a-z]+", s.lower()) for s in re.split(r"[.!?।…\n]+", text) if s.isascii() and s.strip()]


def filler_words(text: str) -> list[str]:
    """The words of a text's mock Latin sentences."""
    return [w for s in _sentences(text) if len(s) >= 2 and SEEDS & set(s) and not FUNCTION & set(s) for w in s]


def markers(text: str) -> Iterator[tuple[str, str, bool, str, str]]:
    """Syntax, normalised name, strength, and the words left and right of every marker."""
    for syntax, pattern, strong in _syntaxes:
        for m in pattern.finditer(text):
            name = re.sub(r"[\s_.\-]+", "_", m.group(1).strip().lower())
            left = re.findall(r"\S+", text[max(0, m.start() - 60) : m.start()])
            right = re.findall(r"\S+", text[m.end() : m.end() + 60])
            mask = lambda words: re.sub(r"\d+", "9", " ".join(words))
            yield syntax, name or syntax, strong, mask((["^"] + left)[-2:]), mask((right + ["$"])[:2])


def residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`id_col` and `reason` (placeholder, filler or message) of the rows with residue in place of content, once each.

    Null, empty and blank texts are no cases, nor are texts that speak about errors or placeholders, nor mark-up. A
    text with placeholders or filler anywhere is a case; a message only if it is the whole text but for navigation.
    Copies of a row are judged alike, and are no evidence: a template is filled in different ways.
    """
    sql_id = df.schema[id_col].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[sql_id]
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = ["id", "found", "syntax", "name", "strong", "left", "right"]
    types = [arrow_id, pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = pc.fill_null(batch.column(1), "")
                some = lambda p, t=texts: pc.match_substring_regex(t, p)
                marked, filled, signal = some(_ANY_MARKER), some(_ANY_FILLER), some(_ANY_SIGNAL)
                hit = pc.or_(pc.or_(marked, filled), signal)
                out: list[tuple] = []
                flags = [x.filter(hit).to_pylist() for x in (marked, filled, signal)]
                for number, text, m, f, s in zip(batch.column(0).filter(hit).to_pylist(), texts.filter(hit).to_pylist(), *flags, strict=True):
                    if m:
                        out += [(number, "marker", *x) for x in markers(text)]
                    if f:
                        if _filler.search(text):
                            out.append((number, "filler", None, None, None, None, None))
                        out += [(None, "word", None, w, None, None, None) for w in set(filler_words(text))]
                    if s:
                        core = core_of(text)
                        if core and _signal.search(core):
                            skeleton = re.sub(r"\d+", "9", re.sub(r"/\S+", "/", core)).lower()
                            opening = " ".join(m.group() for m in islice(re.finditer(r"\w+", skeleton), OPENING_WORDS))
                            out.append((number, "page", opening, _digest(skeleton), bool(_OPENING.match(core)), _digest(text), None))
                columns = list(zip(*out, strict=True)) or [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    shape = f"id {sql_id}, found string, syntax string, name string, strong boolean, `left` string, `right` string"
    seen = stage(base.mapInArrow(look, shape), "residue", by=["found"])

    found = seen.where("found = 'marker'")
    placeholders = _placeholders(found)
    messages = _messages(seen.where("found = 'page'"))

    words = seen.where("found = 'word'").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    hashes = words.select((F.crc32("name") % WORD_HASHES).alias("h")).distinct().toArrow()["h"].to_numpy()
    runs = _runs(base, sql_id, arrow_id, hashes)
    # Words are looked up by hash while scanning, then by name.
    latin = (
        runs.select("id", "run", F.explode("words").alias("name")).join(words, "name", "left_semi")
        .groupBy("id", "run").agg(F.count("*").alias("n")).where(F.col("n") >= RUN_WORDS).select("id")
    )
    parts = [(placeholders, "placeholder"), (seen.where("found = 'filler'").select("id").unionByName(latin), "filler"), (messages, "message")]
    out = None
    for part, reason in parts:
        one = part.distinct().select(F.col("id").alias(id_col), F.lit(reason).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


def _placeholders(found: DataFrame) -> DataFrame:
    """The ids of the markers that the rows say are a template's."""
    named = found.where("syntax not in ('blank', 'default')")
    places = named.groupBy("left", "right", "name").agg(F.max("strong").alias("strong"))
    # Surroundings that hold several names, one of them in a seeded syntax, are a slot.
    slots = places.groupBy("left", "right").agg(F.count("*").alias("n"), F.max("strong").alias("strong")).where("n > 1 and strong").select("left", "right")
    in_slot = places.join(slots, ["left", "right"], "left_semi").select("name").distinct()
    written = named.groupBy("name", "syntax").agg(F.count("*").alias("n"), F.max("strong").alias("strong"))
    several = written.groupBy("name").agg(F.count("*").alias("k"), F.max("strong").alias("s")).where("k > 1 and s").select("name")
    variables = in_slot.union(several).distinct().withColumn("known", F.lit(True))
    of = written.join(variables, "name", "left").groupBy("syntax").agg(
        (F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) + F.when(F.max("strong"), SEED_MARKS).otherwise(0)).alias("yes"),
        (F.sum("n") + F.when(F.max("strong"), SEED_MARKS).otherwise(0) + 1).alias("all"), F.max("strong").alias("strong"))
    templates = of.where(F.col("strong") & (F.col("yes") >= 0.5 * F.col("all"))).select("syntax")  # as many rows as syntaxes
    return (
        found.join(F.broadcast(templates), "syntax", "left_semi").select("id")
        .unionByName(named.join(variables, "name", "left_semi").select("id"))
        .unionByName(found.join(slots, ["left", "right"], "left_semi").select("id"))
    )


def _messages(pages: DataFrame) -> DataFrame:
    """The ids of the pages whose opening the rows say is a message's."""
    filled = pages.select("name", "left").distinct().groupBy("name").agg(F.count("*").alias("forms"))
    known = pages.groupBy("name").agg(F.count("*").alias("n")).join(filled, "name")
    told = stage(spread_lookup(pages.select("id", F.struct("syntax", "strong").alias("opening"), "name", "left"), known, "name", "n"), "pages")
    # Copies of one text count once.
    once = told.select("opening", "name", "left", (F.col("forms") > 1).cast("int").alias("template")).distinct()
    share = once.groupBy("opening").agg(F.sum("template").alias("yes"), F.count("*").alias("all"))
    seeded = F.col("opening.strong")
    believed = F.when(seeded, SEED_PAGES).otherwise(0)
    fits = (F.col("yes") + believed) >= (F.col("all") + believed + 1) * F.when(seeded, SEEDED_SHARE).otherwise(OTHER_SHARE)
    sizes = told.groupBy("opening").agg(F.count("*").alias("n"))
    openings = share.where(fits).select("opening").join(sizes, "opening")
    return spread_lookup(told.select("id", "opening"), openings, "opening", "n").select("id")


def _runs(base: DataFrame, sql_id: str, arrow_id: pa.DataType, hashes: np.ndarray) -> DataFrame:
    """Every run of words whose hashes are those of filler words: `id`, `run`, `words`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, run = np.zeros(WORD_HASHES, bool), TaskContext.get().partitionId() << 40
        known[hashes] = True
        last = re.compile(r"[A-Za-z]+(?=[^A-Za-z]*$)")
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                pieces = pc.split_pattern(pc.fill_null(batch.column(1), ""), " ")
                coded = pc.dictionary_encode(pieces.values)
                plain = [m.group().lower() if (m := last.search(w)) else "" for w in coded.dictionary.to_pylist()]
                is_filler = np.array([bool(w) and known[zlib.crc32(w.encode()) % WORD_HASHES] for w in plain], bool)
                codes = coded.indices.to_numpy(zero_copy_only=False)
                flags = is_filler[codes] if len(codes) else np.zeros(0, bool)
                ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
                out: list[tuple] = []
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if end - start >= RUN_WORDS:
                        row = int(np.searchsorted(ends, start, side="right")) - 1
                        out.append((batch.column(0)[row].as_py(), run, [plain[codes[k]] for k in range(start, end)]))
                        run += 1
                columns = list(zip(*out, strict=True)) or [[], [], []]
                types = (arrow_id, pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "run", "words"])

    return base.mapInArrow(scan, f"id {sql_id}, run bigint, words array<string>")
