"""Raw transcripts into clean, ordered speaker turns.

1. *Tokens*: timestamps and sound annotations are known by their marks, hesitation sounds by patterns and by a
   classifier of short words that is trained on the rows (`fillers`). All are taken out; a row where nothing is left says
   nothing and is dropped. A name printed at the start of an unlabelled row is read there.
2. *Speakers*: labels are normalised (look-alike characters, titles, offices, constituencies, marks of continuation)
   and matched with the members listed for the debate by surname and given names or initials; all labels of the chair
   are one speaker, all labels of unnamed members or groups another.
3. *Boundaries*: whether a new turn begins between two rows that follow one another is decided by gradient-boosted
   trees over labels, gaps and context, trained on all pairs whose speakers are known, beside a hundred pairs of the
   plain rule (an equal speaker goes on), which decide where nothing is known. Pairs that are described alike are
   counted before, so the training is bounded by the features' values.

Rows are ordered inside blocks of `BLOCK` sequence numbers; what a block needs of earlier ones (its last speaker, the
number of turns so far) is added from one row per block, so a debate with a third of all rows is many tasks' work.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.boost import Boosted
from gavel.llm.fillers import learnt, pattern
from gavel.llm.lookalikes import Rewriter
from gavel.operators.relational import spread_lookup
from gavel.sources.staging import stage

BLOCK = 2_048
#: Pairs of the plain rule that are always learnt from beside the labelled ones.
RULE_PAIRS = 100

#: Token classes (fixed patterns): brackets of any kind, sounds in asterisks or dashes, times without brackets.
_BRACKETS = r"\[\[[^\]]*\]\]|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\([^()]*\)"
_SOUNDS = r"\*[^*\n]{1,40}\*|--[^\-\n]{1,40}--|♪[^♪]*♪"
_TIMES = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*-->\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?|\b\d{1,2}:\d{2}(?::\d{2})?\b"
_noise = re.compile(f"(?:{_BRACKETS}|{_SOUNDS}|{_TIMES}|…)")
#: Characters whose look is their own: what is written with these alone needs no look-alike forms to be read.
_OWN = "\\x00-\\x7f\\x{900}-\\x{97f}“”‘’–—…•₹"

#: Brackets, stars and dashes of other forms, which may hold an annotation.
_OTHER_MARKS = "[\\x{ff08}\\x{ff09}\\x{ff3b}\\x{ff3d}\\x{ff5b}\\x{ff5d}\\x{ff1c}\\x{ff1e}\\x{ff0a}\\x{ff0d}\\x{fe59}-\\x{fe5e}\\x{2768}-\\x{2775}\\x{207d}\\x{207e}\\x{208d}\\x{208e}\\p{Ps}\\p{Pe}*♪]|--"


@cache
def _hesitation(more: tuple[str, ...] = ()) -> re.Pattern:
    return re.compile(rf"(?<![^\W_])(?:{pattern(more)})(?![^\W_]|[ऀ-ःऺ-ॏ])", re.I)

#: Titles before names, words of the chair, of unnamed members, and of offices (fixed values).
TITLES = set("shri shrimati smt sri sushri kumari km dr prof professor adv advocate mr mrs ms miss madam sardar hon honble honourable thiru col capt gen justice maulana श्री श्रीमती डॉ प्रो सुश्री कुमारी माननीय".split())
_CHAIR = re.compile(r"\b(?:chair(?:man|person|woman)?|(?:deputy[- ]?)?speaker|presiding)\b|सभापति|अध्यक्ष|उपाध्यक्ष|पीठासीन", re.I)
_CROWD = re.compile(r"\bmembers?\b|\bseveral\b|\binterruptions?\b|सदस्य", re.I)
_OFFICE = re.compile(r"\bminister\b|\bsecretary\b|मंत्री", re.I)
_CONTINUED = re.compile(r"\(?\bcont(?:inue)?d\b[.…)\s]*|\s[–—-]\s*speaker\s*$", re.I)


@cache
def _rewriter() -> Rewriter:
    return Rewriter({})


#: Full-width punctuation and what it looks like, by code point.
_WIDE = {x: x - 0xFEE0 for x in range(0xFF01, 0xFF5F) if not chr(x - 0xFEE0).isalnum()}


def plain(text: str) -> str:
    """The text without look-alikes, with single blanks."""
    return re.sub(r"\s+", " ", text if text.isascii() else _rewriter().rewrite(text).translate(_WIDE)).strip()


def fold(word: str) -> str:
    """A word in lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not ("̀" <= c <= "ͯ"))


def clean(text: str, more: tuple[str, ...] = ()) -> str:
    """What is said: the text without timestamps, annotations and hesitation sounds (`more` are learnt ones)."""
    text = _hesitation(more).sub(" ", _noise.sub(" ", text))
    text = re.sub(r"\s+([,.;:?!।])", r"\1", re.sub(r"(?:,\s*){2,}", ", ", text))
    return re.sub(r"\s+", " ", text).strip(" ,")


def cleaned(texts: pa.Array, more: tuple[str, ...] = ()) -> pa.Array:
    """`clean` of many texts at once; null texts give empty ones."""
    out, edge = pc.fill_null(texts, ""), "[^\\p{L}\\p{M}\\p{N}]"
    out = pc.replace_substring_regex(out, f"(?:{_BRACKETS}|{_SOUNDS}|{_TIMES}|…)", " ")
    for _ in range(2):  # neighbours share what is between them
        out = pc.replace_substring_regex(out, f"(?i)(^|{edge})(?:{pattern(more)})($|{edge})", "\\1 \\2")
    white = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
    for part, to in ((f"(?:,{white}*){{2,}}", ", "), (f"{white}+([,.;:?!।])", "\\1"), (f"{white}+", " ")):
        out = pc.replace_substring_regex(out, part, to)
    return pc.utf8_trim(out, " ,")


def says(texts: pa.Array, more: tuple[str, ...] = ()) -> np.ndarray:
    """Which texts say something. Texts with characters that others look like are read in their plain form, at any length."""
    rest = pc.fill_null(texts, "")
    hesitation = f"(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}])(?:{pattern(more)})($|[^\\p{{L}}\\p{{M}}\\p{{N}}])"
    for part in (_BRACKETS, _SOUNDS, _TIMES, hesitation, hesitation):
        rest = pc.replace_substring_regex(rest, part, " ")
    out = pc.match_substring_regex(rest, "[\\p{L}\\p{N}]").to_numpy(zero_copy_only=False).copy()
    # A word of own characters that stands between blanks is said, unless a bracket of another form may be around it.
    other = pc.match_substring_regex(rest, f"[^{_OWN}]")
    plainly = pc.and_(pc.match_substring_regex(rest, "(^|\\s)[A-Za-z\\x{904}-\\x{939}]{4,}[,.;]?(\\s|$)"), pc.invert(pc.match_substring_regex(rest, _OTHER_MARKS)))
    for k in np.flatnonzero(pc.and_not(other, plainly).to_numpy(zero_copy_only=False) & out):
        out[k] = any(c.isalnum() for c in clean(plain(texts[int(k)].as_py()), more))
    return out


@lru_cache(1 << 16)
def parse(label: str | None) -> tuple[str, list[str], str]:
    """A label's kind (none, chair, crowd, name), its name's folded words, and its title. Labels repeat, so the last ones are kept."""
    if not label or not any(c.isalpha() for c in label):
        return "none", [], ""
    text = plain(label).replace("_", " ")
    text = _CONTINUED.sub(" ", text).strip(" []:-–—.")
    inner = re.findall(r"\(([^()]*)\)", text)
    main = re.sub(r"\([^()]*\)?", " ", text).strip(" :-–—")
    if _CHAIR.search(main):
        return "chair", [], ""
    if _OFFICE.search(main) and inner:
        main = inner[-1]
    elif _CROWD.search(main):
        return "crowd", [], ""
    if "," in main:
        last, _, first = main.partition(",")
        main = f"{first} {last}"
    words = [fold(w) for w in re.split(r"[^\w'’ऀ-ॿ]+", main) if w]
    title = next((w for w in words if w in TITLES and w not in ("hon", "honble")), "")
    names = [w for w in words if w not in TITLES]
    return ("name", names, title) if names else ("none", [], "")


@cache
def _before_name(more: tuple[str, ...] = ()) -> re.Pattern:
    return re.compile(rf"\s*(?:{_BRACKETS}|{_SOUNDS}|{_TIMES}|(?:{pattern(more)})(?![\w])[\s.,…]*)", re.I)


_NAME = re.compile(r"\s*([^:\d;?!।\n]{3,90}?)\s*(?::|\s[-–—])(?:\s|$)")


def printed(text: str | None, more: tuple[str, ...] = ()) -> str | None:
    """The name or office printed at the start of a text, before a colon or a dash between blanks.

    Whatever comes before it of timestamps, annotations and hesitation sounds is passed over, however much it is.
    """
    if not text:
        return None
    start, at = plain(text), 0
    while (m := _before_name(more).match(start, at)) and m.group().strip():
        at = m.end()
    m = _NAME.match(start, at)
    if not m or "," in m.group(1) and not re.match(r"\w+,\s", m.group(1)):
        return None
    kind, names, title = parse(m.group(1))
    if kind in ("chair", "crowd"):
        return m.group(1) if len(m.group(1).split()) <= 5 or "(" in m.group(1) else None
    words = m.group(1).replace("(", " ").split()
    named = title or len(names) >= 2 and m.group(1).isupper()
    return m.group(1) if kind == "name" and named and len(words) <= 8 else None


class Roster:
    """The members listed for a debate, by folded words of their names."""

    def __init__(self, raw: str | None):
        self.members: dict[str, tuple[list[str], str]] = {}
        try:
            listed = json.loads(raw) if raw else []
        except ValueError:
            listed = []
        for member in listed if isinstance(listed, list) else []:
            if isinstance(member, dict) and member.get("mpName"):
                kind, names, title = parse(str(member["mpName"]))
                if kind == "name":
                    self.members[str(member.get("mpCode") or " ".join(names))] = (names, title)

    def find(self, names: list[str], title: str) -> str | None:
        """The only member whose name agrees: same surname, given names or initials in order; titles break ties."""
        fits = [code for code, (own, _) in self.members.items() if own and _agree(names, own)]
        if len(fits) > 1:
            fits = [c for c in fits if self.members[c][0] == names] or [c for c in fits if title and self.members[c][1] == title] or fits
        return fits[0] if len(fits) == 1 else None


def _agree(names: list[str], own: list[str]) -> bool:
    if names[-1] != own[-1]:
        return False
    at = 0
    for word in names[:-1]:
        at = next((k + 1 for k in range(at, len(own) - 1) if own[k] == word or len(word) == 1 and own[k].startswith(word)), 0)
        if not at:
            return False
    return True


def speaker(label: str | None, start: str | None, roster: Roster) -> tuple[str | None, str]:
    """The speaker of a row, null where only the row before tells, and the surname."""
    kind, names, title = parse(label)
    if kind == "none":
        kind, names, title = parse(start)
    if kind in ("chair", "crowd"):
        return kind, ""
    if kind == "none":
        return None, ""
    return f"member {code}" if (code := roster.find(names, title)) else "name " + " ".join(names), names[-1]


FEATURES = ["same", "member", "chair", "crowd", "was_chair", "was_crowd", "surname", "label", "continued", "unlabelled", "gap", "lower", "ended", "short"]


def _rows(turns: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """Narrow rows: what the later steps need of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                texts, labels = batch.column(5), batch.column(4)
                bare = pc.invert(pc.fill_null(pc.match_substring_regex(labels, "\\p{L}"), False)).to_pylist()
                starts = [printed(texts[k].as_py(), more) if b else None for k, b in enumerate(bare)]
                filled = pc.fill_null(texts, "")
                lower = pc.match_substring_regex(filled, "^[^\\p{L}]*\\p{Ll}")
                ended = pc.match_substring_regex(filled, "[.?!।…][^\\p{L}\\p{N}]*$")
                short = pc.less(pc.utf8_length(filled), 80)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(5)), batch.column(6), pa.array(starts, pa.string()), pa.array(says(texts, more)), lower, ended, short],
                    ["id", "debate_id", "seq", "truth", "label", "order", "start", "says", "lower", "ended", "short"],
                )

    return turns.mapInArrow(
        run, "id bigint, debate_id bigint, seq int, truth string, label string, `order` bigint, start string, says boolean, lower boolean, ended boolean, short boolean"
    )


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rosters: dict[int, Roster] = {}
    for batch in batches:
        who, last, continued, unlabelled, form = [], [], [], [], []
        for debate, label, start, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5)), strict=True):
            if debate not in rosters:
                if len(rosters) > 64:
                    rosters.clear()
                rosters[debate] = Roster(raw)
            found, surname = speaker(label, start, rosters[debate])
            bare = not label or not any(c.isalpha() for c in label)
            got = (found, surname, bool(label and _CONTINUED.search(label)), bare, " ".join(sorted(parse(label)[1])))
            for to, value in zip((who, last, continued, unlabelled, form), got, strict=True):
                to.append(value)
        kept = [batch.column(k) for k in (0, 1, 2, 4)]
        more = [pa.array(who, pa.string()), pa.array(last, pa.string()), pa.array(continued, pa.bool_()), pa.array(unlabelled, pa.bool_()), pa.array(form, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*kept, *more], ["debate_id", "label", "start", "_n", "who", "surname", "continued", "unlabelled", "form"]
        )


def _with_previous(rows: DataFrame, values: list[str]) -> DataFrame:
    """`rows` with nulls of `who` replaced by the last one before them in the debate, and `prev_` + `who` and `values` of the row before.

    What a block needs of earlier ones is one row a block: the last `who` that is known, and the last row.
    """
    block = Window.partitionBy("debate_id", "block").orderBy("seq")
    blocks = Window.partitionBy("debate_id").orderBy("block")
    packed = F.struct(*values)
    last = rows.groupBy("debate_id", "block").agg(F.max_by(packed, "seq").alias("_row"), F.max_by("who", F.when(F.col("who").isNotNull(), F.col("seq"))).alias("_who"))
    last = last.select("debate_id", "block", F.lag("_row").over(blocks).alias("_row"), F.last("_who", True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_who"))
    here = lambda end: F.last("who", True).over(block.rowsBetween(Window.unboundedPreceding, end))
    out = rows.withColumn("_p", F.lag(packed).over(block)).withColumn("_h", here(0)).withColumn("_b", here(-1)).join(last, ["debate_id", "block"])
    before = F.coalesce("_p", "_row")
    kept = [c for c in rows.columns if c != "who"]
    return out.select(*kept, F.coalesce("_h", "_who").alias("who"), F.coalesce("_b", "_who").alias("prev_who"), *(before[v].alias(f"prev_{v}") for v in values))


def _numbered(rows: DataFrame, flag: str) -> DataFrame:
    """`rows` with `turn`, the count of set flags up to each row of its debate."""
    block = Window.partitionBy("debate_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = Window.partitionBy("debate_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("debate_id", "block").agg(F.sum(flag).alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(blocks), F.lit(0))).drop("_s")
    out = rows.withColumn("_n", F.sum(flag).over(block)).join(sums, ["debate_id", "block"])
    return out.withColumn("turn", F.col("_n") + F.col("_before")).drop("_n", "_before")


def fitted(pairs: DataFrame) -> Boosted:
    """The boundary decision, learnt from all of `pairs` (`FEATURES`, `new`) whose `new` is known and from those of the plain rule."""
    seen = pairs.where("new is not null").groupBy(*FEATURES, "new").agg(F.count("*").alias("times")).toArrow().sort_by([(c, "ascending") for c in (*FEATURES, "new")])
    # Nulls of a feature are zeros, as they are when it is judged.
    x = np.stack([pc.fill_null(seen[f], 0).to_numpy() for f in FEATURES], axis=1).astype(np.int64)
    rule = np.zeros((RULE_PAIRS, len(FEATURES)), np.int64)
    rule[::2, 0] = 1
    return Boosted().fit(np.concatenate([rule, x]), np.concatenate([1 - rule[:, 0], seen["new"].to_numpy()]), np.concatenate([np.ones(RULE_PAIRS), seen["times"].to_numpy()]))


def _placed(turns: DataFrame, rosters: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """The rows that stay (`debate_id`, `seq`, `who`) with the `turn` of their debate that they belong to; see `clean_turns`."""
    known = F.when(F.col("person_id").isNotNull(), F.concat(F.lit("p"), F.col("person_id"))).when(F.col("role_kind").isNotNull(), F.col("role_kind"))
    narrow = _rows(
        turns.where("debate_id is not null and seq is not null").select(
            F.col("id").cast("bigint"), F.col("debate_id").cast("bigint"), F.col("seq").cast("int"), known.alias("truth"), "speaker_label", "text", F.col("id").cast("bigint").alias("order")
        ),
        more,
    )
    # max_by skips rows with a null order, so a null id counts as the largest.
    rest = ["truth", "label", "start", "lower", "ended", "short", "says"]
    once = narrow.groupBy("debate_id", "seq").agg(F.min_by(F.struct(*rest), F.coalesce("order", F.lit((1 << 63) - 1))).alias("r")).select("debate_id", "seq", "r.*")
    kept = stage(once.where("says").drop("says"), "said")
    lists = rosters.where("debate_id is not null").groupBy(F.col("debate_id").cast("bigint").alias("debate_id")).agg(F.max("mp_list_raw").alias("mp_list_raw"))
    # Lists go only to the different labels of their debates, and what these mean to the rows.
    labels = kept.groupBy("debate_id", "label", "start").agg(F.count("*").alias("_n"))
    read = labels.join(lists, "debate_id", "left").select("debate_id", "label", "start", F.lit(0).alias("_"), "_n", "mp_list_raw").sortWithinPartitions("debate_id").mapInArrow(
        _resolve, "debate_id bigint, label string, start string, _n bigint, who string, surname string, continued boolean, unlabelled boolean, form string"
    )
    known = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c)
    key = F.struct("debate_id", known("label"), known("start"))  # nulls are a value of their own here
    read = stage(read, "labels")
    named = spread_lookup(kept.withColumn("_key", key).drop("label", "start"), read.withColumn("_key", key).drop("debate_id", "label", "start"), "_key", "_n").drop("_key", "_n")
    rows = stage(named.withColumn("block", F.floor(F.col("seq") / BLOCK).cast("int")), "speakers")
    pairs = _with_previous(rows, ["seq", "truth", "surname", "form", "ended"])
    is_ = lambda c, v: (F.coalesce(F.col(c), F.lit("")) == v).cast("int")
    same = lambda c: (F.coalesce(F.col(c), F.lit("")) == F.coalesce(F.col(f"prev_{c}"), F.lit(""))).cast("int")
    columns = {
        "same": same("who"), "member": F.coalesce(F.col("who").startswith("member "), F.lit(False)).cast("int"),
        "chair": is_("who", "chair"), "crowd": is_("who", "crowd"), "was_chair": is_("prev_who", "chair"), "was_crowd": is_("prev_who", "crowd"),
        "surname": same("surname"), "label": same("form"), "continued": F.col("continued").cast("int"), "unlabelled": F.col("unlabelled").cast("int"),
        "gap": F.least(F.col("seq") - F.col("prev_seq"), F.lit(15)), "lower": F.col("lower").cast("int"),
        "ended": F.coalesce("prev_ended", F.lit(True)).cast("int"), "short": F.col("short").cast("int"),
    }
    new = F.when(F.col("truth").isNotNull() & F.col("prev_truth").isNotNull(), (F.col("truth") != F.col("prev_truth")).cast("int"))
    pairs = stage(pairs.select("debate_id", "seq", "block", "who", "prev_seq", new.alias("new"), *(c.alias(n) for n, c in columns.items())), "pairs")
    model = fitted(pairs)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            at = np.stack([pc.fill_null(batch.column(5 + k), 0).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], axis=1) if batch.num_rows else np.zeros((0, len(FEATURES)), np.int64)
            new = (model.predict(at) > 0.5) | first
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(new.astype(np.int32))], ["debate_id", "seq", "block", "who", "new"])

    decided = pairs.select("debate_id", "seq", "block", "who", "prev_seq", *FEATURES).mapInArrow(decide, "debate_id bigint, seq int, block int, who string, new int")
    return _numbered(stage(decided, "decided"), "new").select("debate_id", "seq", "who", "turn")


def clean_turns(turns: DataFrame, rosters: DataFrame) -> DataFrame:
    """The clean turns: `debate_id`, `seq_start`, `seq_end`, `speaker`, `n_rows`.

    turns: `id`, `debate_id`, `seq`, `speaker_label`, `text` and, for training, `person_id` and `role_kind` (both may be
    all null: then equal speakers alone decide). rosters: `debate_id`, `mp_list_raw`. Rows with the same debate and seq
    count once (the smallest id); rows with a null debate or seq take no part; null and empty texts say nothing.
    `speaker` is null for rows at the start of a debate that nothing names; they form one turn. A debate without a
    list, or with one that is no JSON, has its labels compared by their names alone.
    """
    return _summed(_placed(turns, rosters, learnt(turns.select("text")))).drop("turn")


def _summed(rows: DataFrame, *more) -> DataFrame:
    return rows.groupBy("debate_id", "turn").agg(F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"), F.min_by("who", "seq").alias("speaker"), F.count("*").alias("n_rows"), *more)


def _cleaned(more: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), cleaned(batch.column(3), more)], ["debate_id", "seq", "order", "text"])

    return run


def turn_texts(turns: DataFrame, rosters: DataFrame) -> DataFrame:
    """`clean_turns` with `text`: what `clean` leaves of the rows of each turn, in seq order, with blanks between.

    Characters stay as they are written. Of rows with equal debate, seq and id, one with clean words is taken.
    """
    order = F.coalesce(F.col("id").cast("bigint"), F.lit((1 << 63) - 1)).alias("order")
    said = turns.where("debate_id is not null and seq is not null").select(F.col("debate_id").cast("bigint").alias("debate_id"), F.col("seq").cast("int").alias("seq"), order, "text")
    more = learnt(turns.select("text"))
    said = said.mapInArrow(_cleaned(more), "debate_id bigint, seq int, `order` bigint, text string")
    once = said.groupBy("debate_id", "seq").agg(F.min_by("text", F.struct("order", F.col("text") == "", F.xxhash64("text"))).alias("text"))
    rows = _placed(turns, rosters, more).join(once, ["debate_id", "seq"], "left")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"])
    return _summed(rows, F.array_join(F.filter(in_order, lambda t: t != ""), " ").alias("text")).drop("turn")
