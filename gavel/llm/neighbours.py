"""The most similar vectors for every vector: an inverted file with product-quantised residuals.

* *Fit*, on a bounded sample: coarse centroids by k-means on unit vectors, and for each of `PARTS` slices of the
  coordinates a code book for the residuals (vector less its centroid). All of it is broadcast; its size is bounded by
  `MOST_CELLS` and the number of coordinates. Up to the square of half `MOST_CELLS` vectors, the number of centroids
  grows with the root of the vectors, and so does the length of the lists.
* *Lists*: every vector is stored in the lists of its `SPREAD` nearest centroids, with its residual's code there.
  Each query then visits one list, that of its nearest centroid, so a query travels once and its answer is complete
  where it is made.
* *Search*, in the task of a list: asymmetric distance tables (the query is not quantised) estimate every cosine of
  the list. The entries of the best estimates are computed exactly and ranked; more of them, as long as an entry left
  out might, within the fitted error, be better than the last one kept.

Vectors that are equal become one list entry with the smallest ids that could be listed, so a group of copies costs as
much as one vector, and loses nothing. Lists and query groups beyond a bound are split, and the answers merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.sources.staging import stage

#: Vectors that the centroids and code books are fitted on: `CELL_ROWS` for each centroid, from `LEAST_ROWS` to `FIT_ROWS`.
LEAST_ROWS, FIT_ROWS, CELL_ROWS = 20_000, 131_072, 48
MOST_CELLS = 16_384
#: Nearest centroids in whose lists a vector is stored.
SPREAD = 6
#: Slices of the coordinates, each coded in one byte.
PARTS = 12
#: Queries and list entries of one task.
QUERY_ROWS, LIST_ROWS = 8_192, 40_000
#: Queries handled at once in a task, and how many entries are reranked for each: first, then, then all.
CHUNK, RERANK = 64, (32, 256)


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column as unit rows, and which rows they are.

    Usable: not null, of `dims` finite numbers, not all zero.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dims)
    norms = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return (rows[good] / norms[good, None]).astype(np.float32), right[good]


def unit_vectors(df: DataFrame, vector: str, dims: int, *keep: str) -> DataFrame:
    """The columns `keep` and `unit`, the vector at length 1 as little-endian float32 bytes; unusable vectors drop out."""
    kept = df.select(*keep, F.col(vector).cast("array<double>").alias("_vector"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which = _matrix(batch.column(len(keep)), dims)
            data = [rows[k].tobytes() for k in range(len(rows))]
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in range(len(keep))), pa.array(data, pa.binary())], [*keep, "unit"]
            )

    return kept.mapInArrow(run, f"{shape}, unit binary")


def _rows(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def k_means(rows: np.ndarray, k: int, rounds: int, seed: int, unit: bool) -> np.ndarray:
    """At most `k` centres of `rows`; with `unit`, centres of length 1 compared by cosine."""
    rng = np.random.default_rng(seed)
    rows = rows[rng.permutation(len(rows))]
    centres = np.unique(rows[:k], axis=0).copy()
    for _ in range(rounds):
        half = 0.0 if unit else 0.5 * (centres * centres).sum(axis=1)
        nearest = np.concatenate([(rows[at : at + 8192] @ centres.T - half).argmax(axis=1) for at in range(0, len(rows), 8192)])
        order = np.argsort(nearest, kind="stable")
        found, first = np.unique(nearest[order], return_index=True)
        centres[found] = np.add.reduceat(rows[order], first, axis=0)
        if unit:
            length = np.sqrt((centres[found] ** 2).sum(axis=1, keepdims=True))
            centres[found] /= np.maximum(length, 1e-12)
        else:
            centres[found] /= np.diff(np.append(first, len(rows)))[:, None]
    return centres.astype(np.float32)


class Index:
    """Centroids, code books, and the greatest error of an estimate seen on held-out rows."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int, seed: int = 7):
        dims = sample.shape[1]
        unseen = np.arange(len(sample)) % 10 == 9  # for the error; the sample has no order
        apart, sample = sample[unseen], sample[~unseen]
        self.centres = k_means(sample, cells, 8, seed, True)
        nearest = self.nearest(sample, 1)[:, 0]
        residuals = sample - self.centres[nearest]
        cuts = np.linspace(0, dims, min(parts, dims) + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.books = [k_means(residuals[:, s], 256, 6, seed + k, False) for k, s in enumerate(self.slices)]
        if not len(apart):  # too few to say: everything is computed
            self.error = 2.0
            return
        probe, own = sample[:: max(1, len(sample) // 512)], self.nearest(apart, 1)[:, 0]
        error = self.estimate(probe, self.centres[own], self.encode(apart, own)) - probe @ apart.T
        self.error = float(np.abs(error).max()) * 1.1 + 1e-4

    def nearest(self, rows: np.ndarray, many: int) -> np.ndarray:
        """The numbers of the `many` nearest centroids of each row, nearest first."""
        out = []
        for at in range(0, len(rows), 4096):
            score = rows[at : at + 4096] @ self.centres.T
            if many == 1:
                out.append(score.argmax(axis=1)[:, None])
            else:
                some = np.argpartition(-score, min(many, score.shape[1]) - 1, axis=1)[:, :many]
                out.append(np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1), 1))
        return np.concatenate(out) if out else np.zeros((0, many), np.int64)

    def encode(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        residuals = rows - self.centres[cells]
        codes = np.empty((len(rows), len(self.books)), np.uint8)
        for k, (s, book) in enumerate(zip(self.slices, self.books, strict=True)):
            half = 0.5 * (book * book).sum(axis=1)
            for at in range(0, len(rows), 8192):
                codes[at : at + 8192, k] = (residuals[at : at + 8192, s] @ book.T - half).argmax(axis=1)
        return codes

    def estimate(self, queries: np.ndarray, centres: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines, queries by list entries; `centres` is one centroid or one for each entry."""
        out = queries @ centres.T if centres.ndim == 2 else np.repeat((queries @ centres)[:, None], len(codes), 1)
        for k, (s, book) in enumerate(zip(self.slices, self.books, strict=True)):
            table = np.ascontiguousarray((queries[:, s] @ book.T).T)
            out += table[codes[:, k]].T
        return out


def _fit(rows: DataFrame, cells: int, parts: int, fit_rows: int) -> Index | None:
    n, fit_rows = rows.count(), min(fit_rows, max(LEAST_ROWS, CELL_ROWS * cells))
    share = min(1.0, 1.2 * fit_rows / max(n, 1))
    sample = (rows if share >= 1 else rows.sample(share, 11)).limit(fit_rows).toArrow().column("unit").combine_chunks()
    return Index(_rows(sample), min(cells, max(1, len(sample) // 8)), parts) if len(sample) else None


def _counts(df: DataFrame, held: Broadcast, many: int) -> np.ndarray:
    """How many rows each cell gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        total = np.zeros(len(index.centres), np.int64)
        for batch in batches:
            total += np.bincount(index.nearest(_rows(batch.column(0)), many).ravel(), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    got = df.select("unit").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(held.value.centres), np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _assign(held: Broadcast, many: int, own_parts: np.ndarray, other_parts: np.ndarray, names: list[str], coded: bool):
    """Each row once for each of its cells and each part of the other side there: cell, list part, query part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, index = 0, held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = _rows(part.column(part.num_columns - 1))
                cells = index.nearest(rows, many)
                which = np.repeat(np.arange(len(rows)), cells.shape[1])
                cells = cells.ravel()
                own = (turn + np.arange(len(cells))) % own_parts[cells]
                turn += len(cells)
                times = other_parts[cells]
                other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                which, cells, own = (np.repeat(x, times) for x in (which, cells, own))
                take = pa.array(which)
                columns = [part.column(k).take(take) for k in range(part.num_columns)]
                if coded:
                    codes = index.encode(rows[which], cells)
                    columns.append(pa.array([codes[k].tobytes() for k in range(len(codes))], pa.binary()))
                first, second = (own, other) if coded else (other, own)
                keys = [pa.array(x.astype(np.int32)) for x in (cells, first, second)]
                yield pa.RecordBatch.from_arrays([*keys, *columns], names)

    return run


def _best(asked: np.ndarray, rows: np.ndarray, about: np.ndarray, error: float, limit: float, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query some entries and their exact cosines, among them the `most` best of `limit` or more, and all that tie with the last of these.

    `about` holds the estimates, wrong by `error` at most. The `RERANK` best estimates are computed first; that is enough
    where the next estimate can't beat the `most`-th exact value or the limit. Else more are, and in the end all.
    """
    open_ = np.arange(len(asked))
    for many in (*RERANK, rows.shape[0]):
        if many >= rows.shape[0]:
            scores = asked[open_].astype(np.float64) @ rows.T.astype(np.float64)
            for q, score in zip(open_.tolist(), scores, strict=True):
                floor = max(limit, np.partition(score, -most)[-most]) if len(score) > most else limit
                kept = np.flatnonzero(score >= floor)
                yield q, kept, score[kept]
            return
        some = np.argpartition(-about[open_], many, axis=1)
        beyond = np.take_along_axis(about[open_], some[:, many : many + 1], 1)[:, 0] + error
        some = some[:, :many]
        score = np.einsum("qd,qed->qe", asked[open_].astype(np.float64), rows[some].astype(np.float64))
        last = np.partition(score, -most, axis=1)[:, -most] if many > most else np.full(len(open_), -np.inf)
        done = beyond < np.maximum(last, limit)
        for at in np.flatnonzero(done).tolist():
            kept = score[at] >= max(limit, last[at])
            yield int(open_[at]), some[at][kept], score[at][kept]
        open_ = open_[~done]
        if not len(open_):
            return


def _search(held: Broadcast, limit: float, k: int):
    def run(key: tuple, queries: pa.Table, entries: pa.Table) -> pa.Table:
        shape = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("found", pa.int64()), ("cosine", pa.float64())])
        if not queries.num_rows or not entries.num_rows:
            return shape.empty_table()
        index = held.value
        centre = index.centres[key[0].as_py()]
        rows = _rows(entries["unit"].combine_chunks())
        codes = np.frombuffer(b"".join(entries["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
        members = entries["ids"].to_pylist()
        first = np.array([m[0] for m in members], np.int64)
        kinds, ids, owns = (queries[c].to_pylist() for c in ("kind", "id", "own"))
        asked = _rows(queries["unit"].combine_chunks())
        out: list[tuple] = []
        for at in range(0, len(asked), CHUNK):
            block = asked[at : at + CHUNK]
            # Every entry has an id that may be listed, but for the query's own: one more than k holds the k best ids.
            for q, which, scores in _best(block, rows, index.estimate(block, centre, codes), index.error, limit, k + 1):
                own, order = owns[at + q], np.lexsort((first[which], -scores))[: k + 1]
                top = sorted((-scores[j], m) for j in order.tolist() for m in members[which[j]] if m != own)
                out += [(kinds[at + q], ids[at + q], m, -float(s)) for s, m in top[:k]]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)

    return run


def most_similar(
    base: DataFrame,
    queries: DataFrame,
    dims: int,
    k: int = 5,
    limit: float = 0.8,
    spread: int = SPREAD,
    cells: int | None = None,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """For each query the up to `k` base ids with the highest cosine of at least `limit`: `kind`, `id`, `found`, `cosine`.

    base: `id`, `vector`. queries: `kind`, `id`, `own` (a base id not to be listed for this query, or null), `vector`.
    Vectors that are null, all zero, not finite or not of `dims` numbers take no part. A base id that occurs several
    times counts once, with its best vector. Ties go to the smaller id. Queries without an answer have no row. Repeated
    queries (same kind and id) are answered as often as they occur, with the same rows where their vectors are equal.
    `spread`, `cells` (by default twice the root of the number of base vectors, at most `MOST_CELLS`) and `fit_rows`
    set recall against work.
    """
    units = unit_vectors(base.select(F.col("id").cast("bigint").alias("id"), "vector"), "vector", dims, "id")
    copies = Window.partitionBy("unit").orderBy("id")
    # Repeats go first and are spread by both columns; then each task passes on at most k + 1 ids of a vector.
    entries = stage(
        units.distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
        .groupBy("unit").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "unit"),
        "vectors",
    )
    asked = unit_vectors(
        queries.select("kind", F.col("id").cast("bigint").alias("id"), F.col("own").cast("bigint").alias("own"), "vector"),
        "vector", dims, "kind", "id", "own",
    )
    n = entries.count()
    index = _fit(entries.select("unit"), cells or min(MOST_CELLS, math.ceil(2 * math.sqrt(n))), PARTS, fit_rows) if n else None
    if index is None:
        return asked.sparkSession.createDataFrame([], "kind string, id bigint, found bigint, cosine double")
    held, spread = asked.sparkSession.sparkContext.broadcast(index), min(spread, len(index.centres))
    list_parts = np.maximum(1, -(-_counts(entries, held, spread) // LIST_ROWS))
    query_parts = np.maximum(1, -(-_counts(asked, held, 1) // QUERY_ROWS))
    keys = ["cell", "list_part", "query_part"]
    shape = "cell int, list_part int, query_part int"
    stored = entries.mapInArrow(
        _assign(held, spread, list_parts, query_parts, [*keys, "ids", "unit", "code"], True),
        f"{shape}, ids array<bigint>, unit binary, code binary",
    )
    visits = asked.mapInArrow(
        _assign(held, 1, query_parts, list_parts, [*keys, "kind", "id", "own", "unit"], False),
        f"{shape}, kind string, id bigint, own bigint, unit binary",
    )
    found = visits.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(
        _search(held, limit, k), "kind string, id bigint, found bigint, cosine double"
    )
    if list_parts.max() == 1:
        return found
    best = Window.partitionBy("kind", "id").orderBy(F.desc("cosine"), "found")
    return (
        found.groupBy("kind", "id", "found").agg(F.max("cosine").alias("cosine"))
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    )
