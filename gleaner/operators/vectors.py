"""Exact search of the nearest vectors by cosine, with cells that bounds skip.

Vectors of a length are put into cells around pivots, which are chosen far apart from a bounded
sample. A row of the stored table is a part of a cell: at most some hundred unit vectors, and the
least and the largest angle between them and the pivot. Cells are made where vectors are read, so
building shuffles nothing but the sample.

By the triangle inequality of angles, a part's vectors are no nearer to a query than the query's angle
to the pivot lies outside of the part's. A task skips a part for every query whose k best that cannot
reach; from the start it knows the k-th best score within the sample, whose vectors are entries too.
Results are those of comparing every pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.operators.index import Best, over_blocks, query_blocks, rounded
from gleaner.storage import grouped, keep, once, stamp

#: Vectors of the sample, pivots for each length, and vectors of a part, at most.
SAMPLE, PIVOTS, PART = 4096, 64, 256
#: Queries that are held in memory at once, and scores.
QUERY_BLOCK, SCORE_CELLS = 4096, 250_000
#: Added to a bound on a cosine: more than the error of the angle of two nearly equal vectors.
SLACK = 1e-7
#: Parts of a row group of the stored table, which a reader holds at once.
GROUP = 64
CELLS = "size int, cell int, low double, high double, pos array<{key}>, vectors array<double>"


@dataclass(frozen=True)
class VectorIndex:
    """``cells`` is the stored table; ``sample`` has the unit vectors of the sample by length."""

    cells: DataFrame
    sample: dict[int, np.ndarray]

    def write(self, path: str) -> VectorIndex:
        spark = self.cells.sparkSession
        schema = pa.schema([("size", pa.int32()), ("vectors", pa.list_(pa.float64()))])
        # From Arrow, so that no executor starts Python workers of another kind beside those of a search.
        rows = pa.table({"size": list(self.sample), "vectors": [matrix.ravel() for matrix in self.sample.values()]}, schema)
        spark.createDataFrame(rows).write.parquet(f"{path}/sample")
        self.cells.write.options(**grouped(GROUP)).parquet(f"{path}/cells")
        return read(spark, path)

    def keep(self) -> VectorIndex:
        """The index with its cells in the shared folder, for this session or block only."""
        return VectorIndex(keep(self.cells, options=grouped(GROUP)), self.sample)


def read(spark: SparkSession, path: str) -> VectorIndex:
    sample = {r["size"]: np.array(r["vectors"]).reshape(-1, r["size"]) for r in spark.read.parquet(f"{path}/sample").collect()}
    return VectorIndex(spark.read.parquet(f"{path}/cells"), sample)


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def pivots_of(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        at = int(near.argmin())
        if near[at] > 1 - SLACK:
            break
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    return sample[chosen]


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def usable(entries: DataFrame, key: str, vector: str) -> DataFrame:
    return entries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("pos"), F.col(vector).cast("array<double>").alias("vector"))


def build(entries: DataFrame, key: str = "pos", vector: str = "embedding") -> VectorIndex:
    """The index of the entries that have a vector that is not all zeros."""
    rows = usable(entries, key, vector)
    sample = defaultdict(list)
    for r in rows.filter(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("pos", "vector"), "pos").limit(SAMPLE).collect():
        sample[len(r["vector"])].append(r["vector"])
    sample = {size: unit(np.array(own)) for size, own in sample.items()}
    pivots = {size: pivots_of(matrix) for size, matrix in sample.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = batch.column(0), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for size in np.unique(sizes[sizes > 0]).tolist():
                index = np.flatnonzero(sizes == size)
                own = vectors.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False).reshape(len(index), size)
                some = np.linalg.norm(own, axis=1) > 0
                yield from _parts(size, keys.take(pa.array(index[some])), unit(own[some]), pivots.get(size))

    return VectorIndex(rows.mapInArrow(run, CELLS.format(key=rows.schema["pos"].dataType.simpleString())), sample)


def _parts(size: int, keys: pa.Array, own: np.ndarray, pivots: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Parts of the cells of a batch's vectors of one length. Without pivots, as for a length that the sample lacks, nothing bounds them."""
    if not len(own):
        return
    if pivots is None:
        cell, angle = np.full(len(own), -1), np.zeros(len(own))
    else:
        cosines = own @ pivots.T
        cell = cosines.argmax(1)
        angle = angles(cosines[np.arange(len(own)), cell])
    order = np.lexsort((angle, cell))
    edges = np.flatnonzero(np.diff(cell[order])) + 1
    for begin, end in zip([0, *edges], [*edges, len(order)], strict=True):
        for at in range(begin, end, PART):
            some = order[at : min(at + PART, end)]
            some = some[np.argsort(keys.take(pa.array(some)).to_numpy(zero_copy_only=False), kind="stable")]
            low, high = (0.0, np.pi) if pivots is None else (angle[some].min(), angle[some].max())
            wrap = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([int(cell[some[0]])], pa.int32()), pa.array([low]), pa.array([high]), wrap(keys.take(pa.array(some))), wrap(pa.array(own[some].ravel()))], ["size", "cell", "low", "high", "pos", "vectors"])


def stored(entries: DataFrame, name: str, tables: list[str]) -> VectorIndex:
    """The session's index of that name, built when it is first asked for and again when a file of ``tables`` changed."""
    spark = entries.sparkSession
    return read(spark, once(spark, f"vectors-{name}-{stamp(spark, tables)}", lambda path: build(entries).write(path)))


class Queries:
    """The queries of a block that have vectors of one length."""

    def __init__(self, rows: list[tuple[object, list[float]]], k: int, sample: np.ndarray | None):
        self.ids = [i for i, _ in rows]
        raw = np.array([v for _, v in rows], float).reshape(len(rows), -1)
        self.matrix, self.blank = unit(raw), np.linalg.norm(raw, axis=1) == 0
        self.least = np.full(len(rows), -np.inf)
        self.angles = None
        if sample is not None:
            self.angles = angles(self.matrix @ pivots_of(sample).T)
            if len(sample) >= k:
                scores = self.matrix @ sample.T
                self.least = rounded(np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k] - SLACK)

    def bounds(self, cell: int, low: float, high: float) -> np.ndarray:
        """The most that the cosine with a vector of a part can be."""
        if self.angles is None or cell < 0:
            return np.ones(len(self.ids))
        own = self.angles[:, cell]
        return np.where(self.blank, 0.0, np.cos(np.clip(np.maximum(own - high, low - own), 0.0, np.pi))) + SLACK


class Searcher:
    """The k nearest entries of the queries of one length, over the parts of a task."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, self.best = queries, k, None
        self.scored = self.passed = 0

    def add(self, cell: int, low: float, high: float, keys: np.ndarray, vectors: np.ndarray) -> None:
        if self.best is None:
            self.best = Best(self.k)
            self.best.scores = np.full((self.k, len(self.queries.ids)), -np.inf)
            self.best.keys = np.full((self.k, len(self.queries.ids)), keys[0], keys.dtype)
        least = np.maximum(self.queries.least, rounded(self.best.scores[-1]))
        columns = np.flatnonzero(rounded(self.queries.bounds(cell, low, high)) >= least)
        self.passed += len(keys) * len(least)
        self.scored += len(keys) * len(columns)
        step = max(1, SCORE_CELLS // len(keys))
        for at in range(0, len(columns), step):
            some = columns[at : at + step]
            self.best.add(vectors.reshape(len(keys), -1) @ self.queries.matrix[some].T, keys, some)

    def found(self) -> tuple[list, np.ndarray, np.ndarray]:
        """Query, key and score of what was held."""
        rank, column = np.nonzero(self.best.scores > -np.inf)
        return [self.queries.ids[i] for i in column.tolist()], self.best.keys[rank, column], self.best.scores[rank, column]


def search(queries: DataFrame, index: VectorIndex, k: int, query: str = "query_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, pos, score): the k nearest entries a query and task, of which the k best of all are taken by the caller."""
    spark = index.cells.sparkSession
    id_type, key_type = queries.schema[query].dataType, index.cells.schema["pos"].dataType.elementType
    schema = f"query_id {id_type.simpleString()}, pos {key_type.simpleString()}, score double"
    arrow = [to_arrow_type(t) for t in (id_type, key_type)]
    asked = queries.filter(F.col(vector).isNotNull()).select(query, F.col(vector).cast("array<double>").alias("vector"))

    def over(found: list):
        by_size = defaultdict(list)
        for r in found:
            by_size[len(r["vector"])].append((r[query], r["vector"]))
        held = spark.sparkContext.broadcast({size: Queries(rows, k, index.sample.get(size)) for size, rows in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {size: Searcher(queries, k) for size, queries in held.value.items()}
            for batch in batches:
                sizes, cells, low, high = (batch.column(c).to_pylist() for c in range(4))
                for i, size in enumerate(sizes):
                    if size in own:
                        own[size].add(cells[i], low[i], high[i], batch.column(4)[i].values.to_numpy(zero_copy_only=False), batch.column(5)[i].values.to_numpy())
            for searcher in own.values():
                if searcher.best is not None:
                    ids, keys, scores = searcher.found()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, arrow[0]), pa.array(keys, arrow[1]), pa.array(scores)], ["query_id", "pos", "score"])

        return index.cells.mapInArrow(run, schema), held

    parts = over_blocks(query_blocks(asked, block), over)
    return (spark.createDataFrame([], schema) if parts is None else parts).withColumnRenamed("query_id", query)
