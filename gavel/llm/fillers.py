"""Which words are hesitation sounds, learnt from the rows.

Every short word of the corpus (up to `MOST_LETTERS` letters, repeated ones twice) is described by how often it occurs and
how it stands: after a break, with punctuation, inside brackets, first in its row, alone in it, and by its letters. Fixed
patterns label the words to learn from; boosted trees trained on all of them then judge every short word. Words that are
described alike are one row of the training with their number, so its size is bounded by the features' values.
A word that the patterns don't have counts if it is judged more surely than 95 in 100 of its kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.boost import BINS, Boosted
from gavel.sources.staging import stage

#: Hesitation sounds to learn from (fixed patterns).
HESITATIONS = "u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|a+h+|e+h+|अं+|उम्+म*|हम्+म*|ऊं+|आं+"
MOST_LETTERS = 6
FOLDS = 5
#: Least probability of a word that the patterns don't have.
LEAST_SURE = 0.8
COUNTS = ["n", "broken", "marked", "inside", "first", "alone"]
_bare = re.compile(r"^[^\w]*([^\W\d_]+[ऀ-ॏ]*(?:[^\W\d_]|[ऀ-ॏ])*)[^\w]*$")
#: Punctuation that sets a word apart; a full stop may be an abbreviation's.
_breaks = re.compile(r"[,;:!?…—–-]$|\.\.$")
_seed = re.compile(f"(?:{HESITATIONS})")


def kind_of(token: str) -> str | None:
    """The short word that a token is: its letters in lower case, each run of one letter as two; null for anything else."""
    m = _bare.match(token)
    short = re.sub(r"(.)\1+", r"\1\1", m.group(1).lower()) if m else ""
    return short if 0 < len(short) <= MOST_LETTERS else None


def counted(texts: DataFrame) -> DataFrame:
    """`word` and the `COUNTS` of every short word of the one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                pieces = pc.split_pattern_regex(pc.utf8_trim_whitespace(pc.fill_null(whole.column(0).slice(start, 4000), "")), "\\s+")
                coded = pc.dictionary_encode(pieces.values)
                tokens, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
                if not len(codes):
                    continue
                ends = np.array([bool(_breaks.search(t)) for t in tokens])
                begin = np.zeros(len(codes), bool)
                begin[offsets[:-1][np.diff(offsets) > 0]] = True
                before = begin | np.concatenate([[True], ends[codes][:-1]])
                lonely = np.zeros(len(codes), bool)
                lonely[offsets[:-1][np.diff(offsets) == 1]] = True
                sums = [np.bincount(codes, w, len(tokens)) for w in (np.ones(len(codes)), before, before & ends[codes], np.zeros(len(codes)), begin, lonely)]
                table = np.stack(sums, axis=1)
                for k, token in enumerate(tokens):
                    word = kind_of(token)
                    if word:
                        row = table[k].copy()
                        row[3] = row[0] if any(c in token for c in "()[]{}<>*") else 0
                        if word in total:
                            total[word] += row
                        else:
                            total[word] = row
        words = list(total)
        rows = np.stack([total[w] for w in words]).astype(np.int64) if words else np.zeros((0, len(COUNTS)), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["word", *COUNTS])

    each = texts.mapInArrow(run, "word string, " + ", ".join(f"`{c}` bigint" for c in COUNTS))
    return each.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def features(words: list[str], counts: np.ndarray) -> np.ndarray:
    """What a word is judged by, in small numbers: shares of its occurrences in fifteenths, its frequency, its letters."""
    n = np.maximum(counts[:, :1], 1)
    shares = np.rint(counts[:, 1:] * 15 / n).astype(np.int64)
    vowels = [sum(c in "aeiouअआइईउऊएऐओऔ" for c in w) for w in words]
    letters = np.array([(len(w), v, len(w) - v, w[-1:] in "hmrंम्", w[:1] in "aehmuअआऊउह") for w, v in zip(words, vowels, strict=True)], np.int64).reshape(-1, 5)
    return np.concatenate([np.log2(n).astype(np.int64), shares, letters], axis=1)


def _sides(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % FOLDS for w in words], np.int64)


def examples(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words to learn from: features, whether the patterns have them, their fold, and how many words are alike in these.

    A feature has at most `BINS` values, most of them few, so what reaches the driver doesn't grow with the words.
    """
    names = ["y", "side", *(f"f{k}" for k in range(6 + 5))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            x = np.minimum(features(some, np.stack([batch.column(1 + k).to_numpy() for k in range(len(COUNTS))], axis=1)), BINS - 1)
            columns = [np.array([bool(_seed.fullmatch(w)) for w in some], np.int64), _sides(some), *x.T]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names)

    got = words.mapInArrow(run, ", ".join(f"{n} int" for n in names)).groupBy(*names).agg(F.count("*").alias("times")).toArrow().sort_by([(n, "ascending") for n in names])
    y, side, *x = (got[n].to_numpy() for n in names)
    return np.stack(x, axis=1).astype(np.int64), y == 1, side, got["times"].to_numpy()


def _quantile(values: np.ndarray, times: np.ndarray, share: float) -> float:
    """The lower quantile of values that occur so many times."""
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(times[order]), int(share * (times.sum() - 1)), side="right")])


def learnt(texts: DataFrame) -> tuple[str, ...]:
    """The short words beside the patterns that are hesitation sounds by how they stand in these texts, in order.

    There are at most as many as short words are judged so, which their number of letters bounds. Without any word that
    the patterns have, nothing can be learnt and the answer is empty.
    """
    words = stage(counted(texts), "words")
    x, y, side, times = examples(words)
    if not y.any():
        return ()
    # Each fold of the words is judged by a model of the others: no word is judged by a model that has its label.
    models = [Boosted(least=1.0).fit(x[side != k], y[side != k].astype(float), times[side != k]) for k in range(FOLDS)]
    sure = np.concatenate([models[k].predict(x[(side == k) & ~y]) for k in range(FOLDS)])
    limit = max(LEAST_SURE, _quantile(sure, np.concatenate([times[(side == k) & ~y] for k in range(FOLDS)]), 0.95)) if len(sure) else LEAST_SURE

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            at = features(some, np.stack([batch.column(1 + k).to_numpy() for k in range(len(COUNTS))], axis=1))
            sure = np.choose(_sides(some), [m.predict(at) for m in models]) > limit
            kept = [w for w, s in zip(some, sure, strict=True) if s and not _seed.fullmatch(w)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["word"])

    return tuple(sorted(r["word"] for r in words.mapInArrow(judge, "word string").collect()))


def pattern(more: tuple[str, ...] = ()) -> str:
    """A pattern of the hesitation sounds and `more` words, any letter of which may be repeated."""
    return "|".join([HESITATIONS, *(re.sub(r"(\w)(?!\1)", r"\1+", w) for w in more)])
