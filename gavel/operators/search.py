"""Word search: postings, ranking, fusion of ranked lists, dictionary matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions import text as tx
from gavel.operators.relational import spread_lookup
from gavel.sources.staging import stage

try:
    import ahocorasick
except ImportError:  # then dictionaries of any size are looked up by joins
    ahocorasick = None


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """`id`, `word`, `tf`, `length`: how often each word of a document occurs, and how many words it has."""
    d = docs.select(F.col(id_col).alias("id"), tx.once(tokens).alias("_t")).withColumn("length", F.size("_t"))
    return d.select("id", "length", F.explode("_t").alias("word")).groupBy("id", "length", "word").agg(F.count("*").alias("tf"))


def _equals(word: str):
    return lambda t: t == word


def bm25(docs: DataFrame, id_col: str, tokens: Column, words: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`id` and `score` of the documents with any of the words, by BM25.

    Only rows with a query word are exploded; document count and mean length come from a narrow aggregate over all.
    """
    words = list(dict.fromkeys(words))
    d = docs.select(F.col(id_col).alias("id"), tx.once(tokens).alias("_t")).withColumn("length", F.size("_t"))
    total = d.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = F.filter(F.array(*(F.struct(F.lit(w).alias("word"), F.size(F.filter("_t", _equals(w))).alias("tf")) for w in words)), lambda x: x["tf"] > 0)
    hits = d.where(F.arrays_overlap("_t", F.array(*map(F.lit, words)))).select("id", "length", F.inline(tf))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "word").join(F.broadcast(total))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return rows.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def fuse(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (`id`, `rank` from 1): `id`, `score` = sum of 1 / (k + rank), `n_lists`."""
    rows = lists[0].select("id", "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("id", "rank"))
    return rows.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_lists"))


def ranked(df: DataFrame, score: str, most: int) -> DataFrame:
    """The `most` best ids with their rank from 1, ties by id."""
    top = df.orderBy(F.desc(score), "id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


#: Bytes of a dictionary up to which every task gets all of it.
MOST_DICTIONARY = 64 << 20


def dictionary_hits(docs: DataFrame, id_col: str, text: Column, names: DataFrame, name_col: str, most: int | None = 8) -> DataFrame:
    """Names of a dictionary that occur in texts as runs of words: `id`, `name`, `tf`, `score` = tf * ln(N / df), the best `most` each (all with null).

    Names may have any number of words; both sides are compared as lower-case words, so white space and punctuation
    between them don't matter. A match inside a longer match at the same place doesn't count. A dictionary whose size is
    checked to be at most `MOST_DICTIONARY` bytes goes to every task as one automaton; for a larger one, only runs that
    begin with the first word of a name, at the lengths such names have, are looked up by an equi-join.
    """
    dictionary = stage(names.select(tx.tokens(F.col(name_col)).alias("w")).where(F.size("w") > 0).select(F.array_join("w", " ").alias("name"), F.col("w")[0].alias("first"), F.size("w").alias("words")).distinct(), "dictionary")
    size = dictionary.agg(F.sum(F.octet_length("name") + 16).alias("n")).first()["n"] or 0
    rows = docs.select(F.col(id_col).alias("id"), tx.once(tx.tokens(text)).alias("_t"))
    if ahocorasick is not None and size <= MOST_DICTIONARY:
        found = _by_automaton(rows, [r["name"] for r in dictionary.select("name").toLocalIterator()])
    else:
        found = _by_first_words(rows, dictionary)
    tf = found.groupBy("id", "name").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("name").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    scored = tf.join(df, "name").join(F.broadcast(total)).withColumn("score", F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), 6))
    if most is not None:
        scored = scored.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "name"))).where(F.col("_r") <= most)
    return scored.select("id", "name", "tf", "score")


def _by_automaton(rows: DataFrame, names: list[str]) -> DataFrame:
    """`id`, `name`, `tf` in the words of each row; runs inside a longer one at the same place are left out."""
    kind = rows.schema["id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for name in held.value:
            machine.add_word(f" {name} ", name)
        machine.make_automaton()
        for batch in batches:
            at, found, times = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist() if held.value else ()):
                reach, counts = -1, {}
                for start, end, name in sorted((e - len(n) - 1, -e, n) for e, n in machine.iter(text)):
                    if -end > reach:
                        counts[name] = counts.get(name, 0) + 1
                        reach = -end
                at += [k] * len(counts)
                found += counts
                times += counts.values()
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string()), pa.array(times, pa.int64())], ["id", "name", "tf"])

    padded = F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" "))
    return rows.select("id", padded.alias("_text")).mapInArrow(run, f"id {kind}, name string, tf bigint")


def _by_first_words(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same by joins."""
    found = _runs(rows, dictionary)
    w = Window.partitionBy("_row").orderBy("at", F.desc("words")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_reach", F.max(F.col("at") + F.col("words")).over(w)).where(F.col("_reach").isNull() | (F.col("at") + F.col("words") > F.col("_reach")))
    return found.groupBy("id", "name").agg(F.count("*").alias("tf"))


def _runs(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every run of words (`_row`, `id`, `at`, `words`, `name`) that is a name: places with a first word, then the runs there. Texts travel once, and only to their places."""
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    lengths = dictionary.groupBy("first").agg(F.collect_set("words").alias("lengths"))
    places = rows.select("_row", F.posexplode("_t").alias("at", "first")).join(lengths, "first").groupBy("_row").agg(F.collect_list(F.struct("at", "lengths")).alias("places"))
    each = "flatten(transform(places, p -> transform(filter(p.lengths, k -> p.at + k <= size(_t)), k -> struct(p.at as at, k as words, array_join(slice(_t, p.at + 1, k), ' ') as name))))"
    runs = rows.join(places, "_row").select("_row", "id", F.explode(F.expr(each)).alias("r")).select("_row", "id", "r.*")
    return runs.join(dictionary.select("name"), "name")


def named_runs(docs: DataFrame, id_col: str, text: Column, names: DataFrame) -> DataFrame:
    """Names in texts from left to right, the longest at each place and none inside another: `id`, `at` (the word, from 1), `name`, `kind`.

    names: `name`, `kind`; a name with several kinds has the first in order. Repeated ids are texts of their own.
    """
    one = names.select(tx.tokens(F.col("name")).alias("w"), "kind").where(F.size("w") > 0).groupBy(F.array_join("w", " ").alias("name"), F.col("w")[0].alias("first"), F.size("w").alias("words")).agg(F.min("kind").alias("kind"))
    one = stage(one, "names")
    runs = _runs(docs.select(F.col(id_col).alias("id"), tx.once(tx.tokens(text)).alias("_t")), one.select("name", "first", "words"))
    packed = runs.groupBy("_row", "id").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("words")).alias("less"), "name"))).alias("m"))
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<at:int,name:string>>").alias("kept"))
    step = lambda s, m: F.when(m["at"] >= s["upto"], F.struct((m["at"] - m["less"]).alias("upto"), F.array_append(s["kept"], F.struct(m["at"].alias("at"), m["name"].alias("name"))).alias("kept"))).otherwise(s)
    kept = packed.select("id", F.explode(F.aggregate("m", start, step)["kept"]).alias("k")).select("id", (F.col("k.at") + 1).alias("at"), "k.name")
    return kept.join(one.select("name", "kind"), "name").select("id", "at", "name", "kind")


#: Names that are multiplied with as many others at a time, and trigrams in a step of it.
NAMES, GRAMS = 2_048, 2_048


def _grams(words: str) -> set[str]:
    """What `tx.trigrams` gives of a text whose words are these, with blanks between."""
    return {f"  {w} "[k : k + 3] for w in words.split() for k in range(len(w) + 1)}


def _placed(names: list[set[str]], places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every trigram of the names that has a place, in the order of columns."""
    at = np.array([(k, places[g]) for k, own in enumerate(names) for g in own if g in places], np.int64).reshape(-1, 2)
    at = at[np.argsort(at[:, 1], kind="stable")]
    return at[:, 0], at[:, 1]


def _shared(left: list[set[str]], right: list[set[str]]) -> np.ndarray:
    """How many trigrams each left name shares with each right one."""
    places = {g: k for k, g in enumerate(sorted(set().union(*left) & set().union(*right)))}
    sides = [(len(names), *_placed(names, places)) for names in (left, right)]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(places), GRAMS):
        width, parts = min(GRAMS, len(places) - start), []
        for n, row, column in sides:
            some = slice(*np.searchsorted(column, (start, start + width)))
            part = np.zeros((n, width), np.float32)
            part[row[some], column[some] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _pairs_of_blocks(least: float):
    def run(table: pa.Table) -> pa.Table:
        own = pc.equal(table["_mine"], table["_i"])
        same = table["_i"][0].as_py() == table["_j"][0].as_py()
        sides = [(t["id"].to_numpy(), [_grams(w) for w in t["words"].to_pylist()]) for t in ((table,) if same else (table.filter(own), table.filter(pc.invert(own))))]
        (ids, names), (other_ids, others) = sides[0], sides[-1]
        sizes, other_sizes = np.array([len(g) for g in names]), np.array([len(g) for g in others])
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for p in range(0, len(names), NAMES):
            for q in range(p if same else 0, len(others), NAMES):
                shared = _shared(names[p : p + NAMES], others[q : q + NAMES])
                both = sizes[p : p + NAMES, None].astype(np.float32) + other_sizes[None, q : q + NAMES].astype(np.float32)
                near = shared * (1 + least) >= least * both - 0.01  # those at the limit are told below
                x, y = np.nonzero(np.triu(near, 1) if same and p == q else near)
                n = shared[x, y].astype(np.float64)
                with np.errstate(invalid="ignore"):
                    s = n / (sizes[p + x] + other_sizes[q + y] - n)
                a, b = ids[p + x], other_ids[q + y]
                fit = ((s >= least) | np.isnan(s)) & (a != b)
                found.append((np.minimum(a, b)[fit], np.maximum(a, b)[fit], s[fit]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b", "similarity"])

    return run


def similar_names(names: DataFrame, keys: Sequence[str], id_col: str, name: Column, least: float) -> DataFrame:
    """Pairs of rows with equal `keys` whose names' trigrams are alike by `least` or more: `a`, `b` (the smaller id first), `similarity`.

    Every pair of rows is compared, exactly: trigrams are shared by nearly all names of an archive, so blocks by trigram hold
    all pairs many times. Rows of equal keys are dealt into blocks of about `NAMES`, and each pair of blocks is one product
    of 0-1 matrices in one group. What travels is each row once for every block of its keys, not the pairs. Rows with a null
    key or id take no part, those with equal ids are no pair, and names without any word are alike with similarity NaN.
    """
    keys = list(keys)
    kind = names.schema[id_col].dataType.simpleString()
    rows = names.select(*keys, F.col(id_col).cast("bigint").alias("id"), F.array_join(tx.tokens(name), " ").alias("words")).dropna(subset=[*keys, "id"]).withColumn("_key", F.struct(*keys))
    sizes = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    dealt = spread_lookup(rows, sizes, "_key", "_n").withColumn("_of", F.ceil(F.col("_n") / NAMES).cast("int"))
    dealt = dealt.withColumn("_mine", F.pmod(F.xxhash64("id", "words"), F.col("_of")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    block = [*keys, "_i", "_j"]
    dealt = dealt.select(*keys, F.least("_mine", "_with").alias("_i"), F.greatest("_mine", "_with").alias("_j"), "_mine", "id", "words")
    # By work, not bytes: adaptive execution would put the small blocks together in few tasks.
    spark = names.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = dealt.repartition(tasks, *block).groupBy(*block).applyInArrow(_pairs_of_blocks(least), "a bigint, b bigint, similarity double")
    return pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "similarity")
