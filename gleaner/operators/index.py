"""A stored inverted index and top-k search over it by block maxima.

The index is three tables: ``kbs`` (entries and mean length of each knowledge base), ``terms`` (how
many entries have a term, and its weight) and ``ranges``. A row of ``ranges`` holds some hundred
entries of one knowledge base: their keys and lengths, their terms in order, and for each term its
entries and how often each has it. Ranges are made where the texts are read, once; the other tables
are sums over ranges, so building the index shuffles the counts of terms of ranges but no text. What
an entry is worth to a term, and the most in each block of entries, a search works out of a range.

A search never reads a text. Queries come in blocks with a bound on queries and on terms; a task
keeps the k best entries a query and passes over its ranges. The maxima bound what a range, and then
each block in it, can score for a query: what cannot enter the k best is not scored. Results are
those of scoring every entry, ties, entries without a common term and negative weights included.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.functions.text import tokenize
from gleaner.storage import grouped, keep, once, small_batches, stamp

# Constants of the ranking.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Entries and, but for a last entry, terms of entries of a range, and entries of a block in it, at most. A range is a
#: row: Parquet, Arrow and Python each hold some rows in copies whose buffers grow by doubling, so it is kept to 2 or 3 MB.
RANGE_ENTRIES, RANGE_TOKENS, BLOCK_ENTRIES = 1024, 100_000, 128
#: Queries, and terms of queries, that are held in memory at once.
QUERY_BLOCK, QUERY_TERMS = 65_536, 4_000_000
#: Ranges of a row group of the stored table: a reader and a writer hold one group, two or three megabytes a range. Each
#: column of so few rows is one page, which the codec holds in buffers outside of the heap.
GROUP = 2
#: Scores, and pairs of an entry's term and a query that has it, that are held at once, each in some ten arrays of that size; so few pairs stay in a core's cache.
SCORE_CELLS, PAIRS = 500_000, 32_000
#: A term is common to a group of queries if more than this part of them have it; groups of a block; and the products of a matrix that take the time of a pair.
COMMON_SHARE, LIKE, PAIR_WORK = 9, 8, 100
#: A bound is widened by this, relative to itself, as it is summed in another order than the scores.
SLACK = 1e-9
RANGE = "kb {kb}, pos array<{key}>, lengths array<int>, terms array<string>, held array<int>, entries binary, times binary"
#: Terms of all queries up to which a search of several blocks first takes the ranges' part that has them.
FEW_TERMS = 4096
#: Bytes of texts that are made into ranges at once.
TEXTS = "4m"

_IN_TOKEN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def corpus_stats(entries: DataFrame, kb: str = "kb", text: str = "text") -> DataFrame:
    """(kb, n, avgdl): entries and their mean length, empty ones counted."""
    length = F.coalesce(F.size(tokenize(F.coalesce(text, F.lit("")))), F.lit(0))
    return entries.groupBy(kb).agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avgdl"))


def entry_counts(entries: DataFrame, kb: str = "kb", text: str = "text") -> DataFrame:
    """(kb, term, df): entries with a term. Each counts once, so terms combine before the shuffle."""
    terms = entries.select(kb, F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))
    return terms.groupBy(kb, "term").agg(F.count(F.lit(1)).alias("df"))


def term_weights(counts: DataFrame, stats: DataFrame, kb: str = "kb", epsilon: float = EPSILON) -> DataFrame:
    """(kb, term, df, idf): a negative idf is replaced by epsilon times the mean idf."""
    same = lambda a, b: F.expr(f"{a}.`{kb}` <=> {b}.`{kb}`")
    raw = counts.alias("c").join(stats.alias("s"), same("c", "s")).select("c.*", "s.n").withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.groupBy(kb).agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf")
    return raw.alias("r").join(mean.alias("m"), same("r", "m")).select(f"r.{kb}", "term", "df", "raw", "mean").select(kb, "term", "df", idf)


@dataclass(frozen=True)
class Index:
    ranges: DataFrame
    terms: DataFrame
    kbs: DataFrame


@dataclass(frozen=True)
class Draft:
    """An index to be written: ``ranges`` are made where the texts are read, in the one pass over them."""

    ranges: DataFrame

    def write(self, path: str) -> Index:
        spark = self.ranges.sparkSession
        with small_batches(spark, TEXTS):
            self.ranges.write.options(**grouped(GROUP)).parquet(f"{path}/ranges")
        ranges = spark.read.parquet(f"{path}/ranges")
        range_stats(ranges).write.parquet(f"{path}/kbs")
        range_terms(ranges, spark.read.parquet(f"{path}/kbs")).write.parquet(f"{path}/terms")
        return read(spark, path)

    def keep(self) -> Index:
        """The index with its tables in the shared folder, for this session or block only."""
        with small_batches(self.ranges.sparkSession, TEXTS):
            ranges = keep(self.ranges, options=grouped(GROUP))
        kbs = keep(range_stats(ranges))
        return Index(ranges, keep(range_terms(ranges, kbs)), kbs)


def read(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("ranges", "terms", "kbs")])


def range_stats(ranges: DataFrame) -> DataFrame:
    """``corpus_stats`` of the entries of stored ranges."""
    each = ranges.select("kb", F.size("pos").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda total, x: total + x).alias("tokens"))
    return each.groupBy("kb").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))


def range_terms(ranges: DataFrame, kbs: DataFrame) -> DataFrame:
    """Weights of the terms of stored ranges: a row a term and range is counted, not one an entry."""
    each = ranges.select("kb", "held", F.posexplode("terms").alias("i", "term")).select("kb", "term", F.expr("held[i]").alias("held"))
    counts = each.groupBy("kb", "term").agg(F.sum("held").alias("df"))
    return term_weights(counts, kbs)


def build(entries: DataFrame, kb: str = "kb", key: str = "pos", text: str = "text") -> Draft:
    """The index of ``entries``; its tables have the columns kb and pos. Keys are not null and sort in a knowledge base."""
    rows = entries.select(F.col(kb).alias("kb"), F.col(key).alias("pos"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_kb = defaultdict(list)
            for i, name in enumerate(batch.column(0).to_pylist()):
                of_kb[name].append(i)
            for index in of_kb.values():
                yield from _ranges(batch.take(pa.array(index)).sort_by("pos"))

    return Draft(rows.mapInArrow(run, RANGE.format(kb=rows.schema["kb"].dataType.simpleString(), key=rows.schema["pos"].dataType.simpleString())))


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of lower-case texts that are not null, one after another, and how many each text has."""
    own = texts.cast(pa.string())
    offsets = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, 4 * own.offset).astype(np.int64)
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside = _IN_TOKEN[data]
    # A token begins, or ends, where the byte before, or after, is none of a token's or of another text.
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin = np.flatnonzero(first)
    upto = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - begin)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(upto), pa.py_buffer(data[inside]))
    return found, np.diff(np.searchsorted(begin, offsets))


def _ranges(rows: pa.RecordBatch, mean: float | None = None) -> Iterator[pa.RecordBatch]:
    """Ranges of a batch of one knowledge base, in order of the keys; with a mean length, entries' times come as what they are worth."""
    found, lengths = tokens_of(rows.column(2))
    coded = found.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    n = rows.num_rows
    pair, times = np.unique(place[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, entry = pair // n, pair % n
    distinct = np.bincount(entry, minlength=n).tolist()
    # Ranges of a batch are of about the same size.
    most = -(-sum(distinct) // max(1, -(-sum(distinct) // RANGE_TOKENS)))
    begin = held = 0
    for i, own in enumerate(distinct):
        held += own
        if i + 1 - begin == RANGE_ENTRIES or held >= most or i == n - 1:
            some = np.flatnonzero((entry >= begin) & (entry <= i))
            made = _range_of(rows.slice(begin, i + 1 - begin), lengths[begin : i + 1], names, term[some], entry[some] - begin, times[some])
            yield made if mean is None else _weighed(made, mean)
            begin, held = i + 1, 0


def _range_of(rows: pa.RecordBatch, lengths: np.ndarray, names: pa.Array, term: np.ndarray, entry: np.ndarray, times: np.ndarray, keys: pa.Array | None = None) -> pa.RecordBatch:
    """A range of entries, which are ``rows`` or have ``keys``: the times of each of ``names`` in each entry, in order of terms and entries."""
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    lists = [rows.column(1) if keys is None else keys, pa.array(lengths, pa.int32()), names.take(pa.array(term[begin])), pa.array(np.diff(begin, append=len(term)), pa.int32())]
    return pa.RecordBatch.from_arrays([rows.column(0).slice(0, 1), *[_one_list(x) for x in lists], _packed(entry), _packed(times)], ["kb", "pos", "lengths", "terms", "held", "entries", "times"])


def _packed(numbers: np.ndarray) -> pa.Array:
    """Numbers as the bytes of the smallest integers that hold them: Spark moves a value a range, not one an entry."""
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if numbers.max(initial=0) <= np.iinfo(k).max)
    return pa.array([numbers.astype(kind).tobytes()], pa.binary())


def _unpacked(value: pa.Scalar, n: int) -> np.ndarray:
    held = value.as_buffer()
    return np.frombuffer(held, f"<i{held.size // n}", n).astype(np.int64) if n else np.zeros(0, np.int64)


def range_parts(rows: pa.RecordBatch) -> Iterator[tuple]:
    """(kb, keys, lengths, terms, starts, entries, times) of each stored range."""
    for i, kb in enumerate(rows.column(0).to_pylist()):
        pos, lengths, terms, held = (rows.column(c)[i].values for c in range(1, 5))
        starts = np.append(0, np.cumsum(held.to_numpy(zero_copy_only=False)))
        yield kb, pos, lengths.to_numpy(zero_copy_only=False), terms, starts, *[_unpacked(rows.column(c)[i], starts[-1]) for c in (5, 6)]


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def worth_of(times: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    """What an entry of some length is worth to a term that it has some times."""
    return times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / mean))


def block_maxima(starts: np.ndarray, entries: np.ndarray, worth: np.ndarray, blocks: int) -> np.ndarray:
    """The most that an entry of each block is worth to each term, a row a term."""
    maxima = np.zeros((len(starts) - 1, blocks))
    at = np.repeat(np.arange(len(starts) - 1) * blocks, np.diff(starts)) + entries // BLOCK_ENTRIES
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    if len(edges):
        maxima.ravel()[at[edges]] = np.maximum.reduceat(worth, edges)
    return maxima


def _weighed(one: pa.RecordBatch, mean: float) -> pa.RecordBatch:
    """A range as a search takes it: worth and block maxima in place of times and lengths."""
    ((_, pos, lengths, terms, starts, entries, times),) = range_parts(one)
    worth = worth_of(times, lengths[entries], mean)
    maxima = block_maxima(starts, entries, worth, -(-len(pos) // BLOCK_ENTRIES))
    lists = [pos, terms, pa.array(starts, pa.int32()), pa.array(entries, pa.int32()), pa.array(worth), pa.array(maxima.ravel())]
    return pa.RecordBatch.from_arrays([one.column(0), *[_one_list(x) for x in lists]], ["kb", "pos", "terms", "starts", "entries", "worth", "maxima"])


def _range(rows: pa.RecordBatch, counts: list[Counter], mean: float) -> pa.RecordBatch:
    """A range of entries whose terms are counted already."""
    names = sorted({t for c in counts for t in c})
    at = {t: i for i, t in enumerate(names)}
    pairs = np.array(sorted((at[t], i, n) for i, c in enumerate(counts) for t, n in c.items()), np.int64).reshape(-1, 3)
    return _weighed(_range_of(rows, np.array([c.total() for c in counts]), pa.array(names, pa.string()), *pairs.T), mean)


def stored(entries: DataFrame, name: str, tables: list[str]) -> Index:
    """The session's index of that name, built when it is first asked for and again when a file of ``tables`` changed."""
    spark = entries.sparkSession
    return read(spark, once(spark, f"index-{name}-{stamp(spark, tables)}", lambda path: build(entries).write(path)))


def query_blocks(queries: DataFrame, size: int, terms: int = QUERY_TERMS) -> Iterator[list]:
    """Rows of ``queries`` in lists of at most ``size`` rows and, but for a last row, ``terms`` terms, read partition by partition."""
    rows, held = [], 0
    for row in queries.toLocalIterator():
        rows.append(row)
        held += len(row["terms"]) if "terms" in row else 0
        if len(rows) == size or held >= terms:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def over_blocks(blocks: Iterator, search) -> DataFrame | None:
    """The union of ``search(block)`` over all blocks.

    ``search`` gives the rows and the broadcast. Each block's rows are written to the shared folder before
    the next block is read, so one block at a time is held, whatever the number of queries, and stored
    rows come to Python in small batches.
    """
    parts = None
    for block in blocks:
        part, held = search(block)
        with small_batches(part.sparkSession):
            part = keep(part)
        held.destroy()
        parts = part if parts is None else parts.unionByName(part)
    return parts


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores to nine digits, as they are compared."""
    return np.rint(scores * 1e9)


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """For each column the rows of its k largest scores to nine digits, of equal ones the first; in order of the rows."""
    n = len(scores)
    if n <= k:
        return np.broadcast_to(np.arange(n)[:, None], scores.shape)
    held = rounded(scores)
    least = np.partition(held, n - k, axis=0)[n - k]
    more, equal = held > least, held == least
    chosen = more | (equal & (np.cumsum(equal, 0) <= k - more.sum(0)))
    return np.nonzero(chosen.T)[1].reshape(-1, k).T


def true_places(mask: np.ndarray) -> np.ndarray:
    """Where a mask with few true cells is true, as places in its flat order; eight cells are looked at in one."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])


class Best:
    """The k best (score, key) of each query, brought up to date batch by batch."""

    def __init__(self, k: int):
        self.k, self.scores, self.keys = k, None, None

    def full(self) -> bool:
        return self.scores is not None and len(self.scores) == self.k

    def add(self, scores: np.ndarray, keys: np.ndarray, columns: np.ndarray | None = None) -> None:
        """``scores`` has a row for each of the ascending ``keys`` and a column for each query, or for those of ``columns`` if k are held."""
        if self.full():
            self._merge(scores, keys, np.arange(scores.shape[1]) if columns is None else columns)
            return
        chosen = best_of(scores, self.k)
        scores, keys = np.take_along_axis(scores, chosen, 0), keys[chosen]
        if self.scores is not None:
            scores, keys = np.vstack([self.scores, scores]), np.vstack([self.keys, keys])
        place = np.unique(keys, return_inverse=True)[1].reshape(keys.shape)
        order = np.lexsort((place, -rounded(scores)), axis=0)[: self.k]
        self.scores, self.keys = np.take_along_axis(scores, order, 0), np.take_along_axis(keys, order, 0)

    def _merge(self, scores: np.ndarray, keys: np.ndarray, columns: np.ndarray) -> None:
        """Put the scores that reach the k-th best into the k best; of ``scores`` nothing is copied but those."""
        least = rounded(self.scores[-1, columns])
        # Lower by more than rounding to nine digits may raise a score.
        floor = (least - 1 - np.abs(least) * 1e-14) / 1e9
        row, column = np.divmod(true_places(scores >= floor), scores.shape[1])
        held, at = np.unique(column, return_inverse=True)
        own = columns[held]
        query = np.concatenate([np.tile(np.arange(len(own)), self.k), at])
        scores = np.concatenate([self.scores[:, own].ravel(), scores[row, column]])
        keys = np.concatenate([self.keys[:, own].ravel(), keys[row]])
        order = np.lexsort((np.unique(keys, return_inverse=True)[1], -rounded(scores), query))
        count = np.bincount(query, minlength=len(own))
        first = np.cumsum(count) - count
        chosen = order[first + np.arange(self.k)[:, None]]
        self.scores[:, own], self.keys[:, own] = scores[chosen], keys[chosen]

    def reach(self, bound: np.ndarray) -> np.ndarray:
        """Whether an entry of at most a bounded score for any query may enter the k best of one."""
        held = rounded(bound * (1 + SLACK)) + 1
        held[bound <= 0] = 0  # nothing but scores of 0 or less: no rounding to allow for
        return held >= rounded(self.scores[-1]).min()

    def open(self, bound: np.ndarray, first: object) -> np.ndarray:
        """The queries whose k best an entry of a bounded score may enter, if its key is ``first`` or later."""
        if not self.full():
            return np.arange(len(bound))
        held, least = rounded(bound * (1 + SLACK)) + 1, rounded(self.scores[-1])
        zero = bound <= 0  # nothing but scores of 0 or less: no rounding to allow for
        held[zero] = 0
        return np.flatnonzero((held > least) | ((held == least) & (self.keys[-1] > first)))


def narrowed(ranges: DataFrame, queries: DataFrame) -> DataFrame:
    """``ranges`` with those terms only that queries of the texts ``text`` have, if these are few; else as they are."""
    terms = lambda rows: rows.select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()
    if terms(queries.limit(1000)).count() > FEW_TERMS:
        return ranges
    wanted = terms(queries).limit(FEW_TERMS + 1).toArrow()["term"].combine_chunks()
    if len(wanted) > FEW_TERMS:
        return ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (_, pos, lengths, names, starts, entries, times) in enumerate(range_parts(batch)):
                known = pc.is_in(names, wanted).to_numpy(zero_copy_only=False)
                some = np.repeat(known, np.diff(starts))
                term = np.repeat(np.arange(len(names)), np.diff(starts))[some]
                yield _range_of(batch.slice(i, 1), lengths, names, term, entries[some], times[some], pos)

    with small_batches(ranges.sparkSession):
        return keep(ranges.mapInArrow(run, ranges.schema))


def text_blocks(rows: DataFrame, query: str, parts: int, size: int, terms: int = QUERY_TERMS) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, tokens and how many of them each query has, of at most ``size`` queries and, but for a last one, ``terms`` terms at once.

    Queries come as Arrow from the parts that their ids' hashes make, so that none is an object of Python.
    """
    for part in range(parts):
        found = rows.filter(F.pmod(F.xxhash64(query), F.lit(parts)) == part).toArrow().combine_chunks()
        if not found.num_rows:
            continue
        ids, texts = (found.column(c).chunk(0) for c in range(2))
        tokens, counts = tokens_of(texts)
        upto = np.append(0, np.cumsum(counts))
        begin = 0
        while begin < len(ids):
            end = max(begin + 1, min(begin + size, int(np.searchsorted(upto, upto[begin] + terms)), len(ids)))
            yield ids.slice(begin, end - begin), tokens.slice(upto[begin], upto[end] - upto[begin]), counts[begin:end]
            begin = end


class Block:
    """Queries by term: for each term the queries that have it and how often."""

    def __init__(self, queries: list[tuple[object, list[str]]] | None = None, given: tuple[pa.Array, pa.Array, np.ndarray] | None = None):
        """Of (id, terms) pairs, in their order; or of ids, tokens and how many each has, put in order by likeness."""
        if given is None:
            ids, lists = [q for q, _ in queries], [terms for _, terms in queries]
            given = pa.array(ids), pa.array([t for terms in lists for t in terms], pa.string()), np.array([len(terms) for terms in lists], np.int64)
        self.ids, tokens, counts = given
        n = len(self.ids)
        coded = tokens.dictionary_encode()
        pair, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), counts), return_counts=True)
        term, query = pair // max(n, 1), pair % max(n, 1)
        self.names, edges = coded.dictionary.to_pylist(), np.array([0, n])
        if queries is None and n >= 64 * LIKE:
            order, edges = alike(term, query, n)
            self.ids = self.ids.take(pa.array(order))
            to = np.empty(n, np.int64)
            to[order] = np.arange(n)
            query = to[query]
            sort = np.argsort(term * n + query)
            term, query, times = term[sort], query[sort], times[sort]
        self.start = np.append(0, np.cumsum(np.bincount(term, minlength=len(self.names)))).astype(np.int64)
        # Each Python worker has a copy, so numbers are small; counts are exact in them.
        self.query, self.times = query.astype(np.int32), times.astype(np.float32)
        #: The most often that any query has a term.
        self.most = np.maximum.reduceat(self.times, self.start[:-1]) if len(term) else np.zeros(0, np.float32)
        self.idf: dict[object, np.ndarray] = {}  # by kb
        # Terms of many queries of a group are multiplied as a dense matrix, the others entry by entry.
        self.edges = edges
        held = np.bincount(term * (len(edges) - 1) + np.searchsorted(edges, query, "right") - 1, minlength=len(self.names) * (len(edges) - 1)).reshape(len(self.names), len(edges) - 1)
        common = COMMON_SHARE * held > np.diff(edges)
        self.wide = np.flatnonzero(common.any(1))
        #: Pairs of a wide term in each group, and where they begin.
        self.held = held[self.wide]
        self.cut = self.start[self.wide][:, None] + np.cumsum(self.held, 1) - self.held
        slot = np.full(len(self.names), -1)
        slot[self.wide] = np.arange(len(self.wide))
        own = slot[term] >= 0
        group = np.searchsorted(edges, query[own], "right") - 1
        self.common = [np.flatnonzero(common[self.wide, g]) for g in range(len(edges) - 1)]
        self.at = np.full((len(edges) - 1, len(self.wide)), -1, np.int32)
        shapes = [(len(c), int(e)) for c, e in zip(self.common, np.diff(edges), strict=True)]
        self.dense = np.zeros(sum(c * e for c, e in shapes))
        self.first = np.append(0, np.cumsum([c * e for c, e in shapes])).astype(np.int64)
        for g, c in enumerate(self.common):
            self.at[g, c] = np.arange(len(c))
            some = np.flatnonzero(group == g)
            at = self.at[g, slot[term[own][some]]]
            self.matrix(g)[at[at >= 0], (query[own][some] - edges[g])[at >= 0]] = times[own][some][at >= 0]

    def matrix(self, group: int) -> np.ndarray:
        """Times of the common terms of a group in its queries."""
        return self.dense[self.first[group] : self.first[group + 1]].reshape(len(self.common[group]), self.edges[group + 1] - self.edges[group])

    def __getstate__(self) -> dict:
        """What tasks get: terms in one Arrow array, not an object each."""
        return self.__dict__ | {"names": pa.array(self.names, pa.string())}

    def product(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, columns: np.ndarray) -> np.ndarray:
        """Sums of value times the query's times of the term: ``rows`` rows, and a column for each of the queries ``columns``.

        A row is multiplied by the matrix of a group of queries where that is less work than to add the
        pairs of its terms and their queries.
        """
        scores, every = np.zeros((rows, len(columns))), len(columns) == len(self.ids)
        slot = np.searchsorted(self.wide, term)
        slot[slot == len(self.wide)] = 0
        known = self.wide[slot] == term if len(self.wide) else np.zeros(len(term), bool)
        own, rare = np.flatnonzero(known), np.flatnonzero(~known)
        slot = slot[own]
        left = [(row[rare], self.start[term[rare]], value[rare], self.start[term[rare] + 1] - self.start[term[rare]])]
        for g in range(len(self.edges) - 1) if len(own) else ():
            at, held = self.at[g, slot], self.held[slot, g]
            matrix, dense = self.matrix(g), at >= 0
            work = np.bincount(row[own], held * dense, rows) * PAIR_WORK > matrix.size
            dense &= work[row[own]]
            if work.any():
                to = np.cumsum(work) - 1
                weights = np.zeros((to[-1] + 1, len(matrix)))
                weights[to[row[own[dense]]], at[dense]] = value[own[dense]]
                if every:
                    scores[work, self.edges[g] : self.edges[g + 1]] = weights @ matrix
                else:
                    some = slice(*np.searchsorted(columns, self.edges[g : g + 2]))
                    scores[work, some] = weights @ matrix[:, columns[some] - self.edges[g]]
            some = np.flatnonzero(~dense & (held > 0))
            left.append((row[own[some]], self.cut[slot[some], g], value[own[some]], held[some]))
        row, begin, value, count = (np.concatenate(x) for x in zip(*left, strict=True))
        if len(row):
            order = np.argsort(row.astype(np.int16), kind="stable")
            row, begin, value, count = row[order], begin[order], value[order], count[order]
            to = None
            if not every:
                to = np.full(len(self.ids), -1, np.int32)
                to[columns] = np.arange(len(columns))
            upto = np.cumsum(count)
            edges = np.unique(np.searchsorted(upto, np.arange(0, upto[-1], PAIRS), "right"))
            for start, end in zip(edges, [*edges[1:], len(row)], strict=True):
                some = slice(start, end)
                self._add_pairs(scores, row[some], begin[some], value[some], count[some], to)
        return scores

    def _add_pairs(self, scores: np.ndarray, row: np.ndarray, begin: np.ndarray, value: np.ndarray, count: np.ndarray, to: np.ndarray | None) -> None:
        """Add what each row's terms are worth to the queries that have them, from where they ``begin``; ``to`` gives a query's column, or -1."""
        upto = np.cumsum(count)
        place = np.repeat(begin - upto + count, count)
        place += np.arange(upto[-1])
        column, amount = self.query.take(place), self.times.take(place) * np.repeat(value, count)
        # Pairs come in order of their rows, so they add to a few of them.
        some = scores[row[0] : row[-1] + 1]
        cell = np.repeat((row - row[0]) * scores.shape[1], count)
        if to is None:
            cell += column
        else:
            column = to.take(column)
            inside = np.flatnonzero(column >= 0)
            cell, amount = cell[inside] + column[inside], amount[inside]
        some += np.bincount(cell, amount, some.size).reshape(some.shape)


def alike(term: np.ndarray, query: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of queries by groups of those with the same frequent terms, and where the groups begin and end."""
    count = np.bincount(term)
    frequent = np.argsort(-count, kind="stable")[:256]
    at = np.full(len(count), -1)
    at[frequent] = np.arange(len(frequent))
    own = at[term] >= 0
    rows = np.zeros((n, len(frequent)), np.float32)
    rows[query[own], at[term[own]]] = 1
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1)
    centres = rows[np.random.default_rng(1).choice(n, LIKE, replace=False)]
    for _ in range(6):
        group = (rows @ centres.T).argmax(1)
        centres = np.stack([rows[group == g].sum(0) for g in range(LIKE)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    group = (rows @ centres.T).argmax(1)
    held = np.bincount(group, minlength=LIKE)
    return np.argsort(group, kind="stable"), np.append(0, np.cumsum(held[held > 0]))


class Searcher:
    """The k best entries of each query of a block, over the ranges of a task."""

    def __init__(self, block: Block, k: int):
        self.block, self.k, self.names = block, k, pa.array(block.names, pa.string())
        self.best: dict[object, Best] = defaultdict(lambda: Best(k))
        self.scored = self.passed = self.misses = self.wait = 0

    def add(self, kb: object, keys: np.ndarray, terms: pa.Array, starts: np.ndarray, entries: np.ndarray, worth: np.ndarray, maxima: np.ndarray | None = None) -> None:
        """One range; its block maxima are those of its worth if they are not given."""
        block, best, n, every = self.block, self.best[kb], len(keys), np.arange(len(self.block.ids))
        # Looked up among the range's terms, which are fewer than the block's.
        place = pc.fill_null(pc.index_in(self.names, terms), -1).to_numpy()
        term = np.flatnonzero(place >= 0)
        term = term[np.argsort(place[term])]
        own = place[term]
        idf = block.idf[kb][term] if kb in block.idf else np.zeros(len(term))
        count = starts[own + 1] - starts[own]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[own], count)
        row, worth, of_term = entries[place].astype(np.int64), worth[place], np.repeat(term, count)
        value = worth * np.repeat(idf, count)
        self.passed += n * len(every)
        left, columns, blocks = np.arange(n), every, -(-n // BLOCK_ENTRIES)
        if best.full():
            # What an entry can be worth to any of the queries.
            left = np.flatnonzero(best.reach(np.bincount(row, np.maximum(value, 0.0) * block.most[of_term], n)))
            pairs = block.start[1:] - block.start[:-1]
            # Bounds for each query are worked out where they take less work than scores, and less often where they spared none.
            work = pairs[term].sum()
            if len(left) and (work <= PAIRS or self.wait <= 0 and 2 * work < pairs[of_term].sum() * len(left) / n):
                most = block_maxima(np.append(0, np.cumsum(count)), row, worth, blocks) if maxima is None else maxima.reshape(len(terms), blocks)[own]
                most, alive = np.maximum(most * idf[:, None], 0.0), np.ones(blocks, bool)
                columns = best.open(block.product(np.zeros(len(term), np.int64), term, most.max(1, initial=0.0), 1, every)[0], keys[0])
                if len(columns) and 2 * len(columns) <= len(every) and blocks > 1:
                    place = np.tile(np.arange(blocks), len(term))
                    bounds = block.product(place, np.repeat(term, blocks), most.ravel(), blocks, columns)
                    for b in range(blocks):
                        some = np.zeros(len(every))
                        some[columns] = bounds[b]
                        alive[b] = len(np.intersect1d(best.open(some, keys[b * BLOCK_ENTRIES]), columns)) > 0
                    left = left[alive[left // BLOCK_ENTRIES]]
                spared = 2 * len(columns) <= len(every) or not alive.all()
                self.misses = 0 if spared else self.misses + 1
                self.wait = min(self.misses, 5) ** 2
                columns = every if 2 * len(columns) > len(every) else columns
            else:
                self.wait -= 1
        if not len(columns) or not len(left):
            return
        if len(left) < n:
            to = np.full(n, -1, np.int64)
            to[left] = np.arange(len(left))
            inside = np.flatnonzero(to[row] >= 0)
            row, of_term, value = to[row[inside]], of_term[inside], value[inside]
        self.scored += len(left) * len(columns)
        held = None if len(columns) == len(every) else columns
        step = max(self.k, SCORE_CELLS // len(columns))
        order = np.argsort(row.astype(np.int16), kind="stable") if step < len(left) else slice(None)
        row, of_term, value = row[order], of_term[order], value[order]
        for at in range(0, len(left), step):
            own = slice(*np.searchsorted(row, [at, at + step])) if step < len(left) else slice(None)
            some = left[at : at + step]
            best.add(block.product(row[own] - at, of_term[own], value[own], len(some), columns), keys[some], held)


def search(queries: DataFrame, index: Index, k: int, query: str = "query_id", block: int = QUERY_BLOCK, text: str = "query") -> DataFrame:
    """(query, kb, pos, score): the k best entries a query, kb and task, of which the k best of all are taken by the caller."""
    spark = index.ranges.sparkSession
    id_type, kinds = queries.schema[query].dataType, index.ranges.schema
    kb_type, key_type = kinds["kb"].dataType, kinds["pos"].dataType.elementType
    schema = f"query_id {id_type.simpleString()}, kb {kb_type.simpleString()}, pos {key_type.simpleString()}, score double"
    arrow = [to_arrow_type(t) for t in (id_type, kb_type, key_type)]
    # As many as there are knowledge bases.
    means = {r["kb"]: r["avgdl"] or 1.0 for r in index.kbs.collect()}

    rows = keep(queries.select(F.col(query), F.lower(F.coalesce(text, F.lit(""))).alias("text")).dropDuplicates([query]))
    n, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # A token takes some six bytes; a part of the queries is a block, or some of few bytes.
    parts = max(length // (5 * QUERY_TERMS), n // QUERY_BLOCK) + 1
    ranges = narrowed(index.ranges, rows) if parts > 1 else index.ranges
    # A task keeps the k best of all that it reads, so there are no more tasks than keep the cores busy.
    ranges = ranges.coalesce(2 * spark.sparkContext.defaultParallelism)

    def over(found: tuple):
        own = Block(given=found)
        own.idf = {name: np.zeros(len(own.names)) for name in means}
        wanted = pa.table({"term": pa.array(own.names, pa.string())})
        # As Arrow, so that no executor starts Python workers of another kind to unpickle rows. At most the block's terms a knowledge base.
        told = index.terms.join(F.broadcast(spark.createDataFrame(wanted)), "term").select("kb", "term", "idf").toArrow()
        at, kb = pc.index_in(told["term"].combine_chunks(), wanted["term"].combine_chunks()).to_numpy(), told["kb"].combine_chunks().dictionary_encode("encode")
        for i, name in enumerate(kb.dictionary.to_pylist()):
            some = kb.indices.to_numpy() == i
            own.idf[name][at[some]] = told["idf"].to_numpy()[some]
        held = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(held.value, k)
            for batch in batches:
                for kb, pos, lengths, terms, starts, entries, times in range_parts(batch):
                    searcher.add(kb, pos.to_numpy(zero_copy_only=False), terms, starts, entries, worth_of(times, lengths[entries], means[kb]))
            for kb, best in searcher.best.items():
                n = len(best.scores)
                ids = pa.concat_arrays([held.value.ids.cast(arrow[0])] * n)
                yield pa.RecordBatch.from_arrays([ids, pa.array([kb] * len(ids), arrow[1]), pa.array(best.keys.reshape(-1), arrow[2]), pa.array(best.scores.reshape(-1))], ["query_id", "kb", "pos", "score"])

        return ranges.mapInArrow(run, schema), held

    parts = over_blocks(text_blocks(rows, query, parts, block), over)
    return (spark.createDataFrame([], schema) if parts is None else parts).withColumnRenamed("query_id", query)
