"""Benchmark decontamination with suffix arrays of the training text.

Each Arrow batch of documents is a shard. Its suffix array holds the positions of the shard at which
a benchmark text can match: words that form, with a neighbour, two consecutive words of the
benchmark (or are a whole one-word item). All other positions cannot start or continue a match, so
leaving them out loses nothing and makes the array small. The windows of all benchmark suffixes are
looked up by binary search, each distinct one once and only if its first two words are in the shard;
the range found holds all its occurrences. The suffixes of the items that occur are then put in order
among those of the shard, and neighbours in that order give the longest verbatim matches and where
they are.

The benchmark is read row by row into blocks of at most ``BLOCK_WORDS`` words (an item is never
split), and the documents pass through one step per block, without a shuffle. A block is broadcast.
Where there are several, the documents are written to the shared folder between two blocks and the
earlier broadcast is dropped, so one block at a time is held.

Defined cases: null and empty texts have no words, match nothing and are kept; an empty benchmark
leaves every document clean; equal documents get equal results; very long and repetitive texts are
taken whole, and no pair of places is listed; null item ids count as the empty text; other columns
pass through, and an added column gets underscores before its name where the input has that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import textscan
from gleaner.llm.common import free_name, keep, on_plain_names

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Words of the benchmark in one block.
BLOCK_WORDS = 1_000_000
_SIEVE_BITS = 20


@dataclass
class Block:
    """Some benchmark items: their words as dense symbols (from 1), one item behind the other."""

    items: list[str]
    symbols: np.ndarray
    item_of: np.ndarray  # of each word
    left: np.ndarray  # words from here to the end of the item, this one included
    words: np.ndarray  # sorted word hashes; word k has symbol k + 1
    pairs: np.ndarray  # sorted hashes of consecutive words
    sieve: np.ndarray  # bits of pairs
    singles: np.ndarray  # sorted hashes of one-word items
    window: int
    query: np.ndarray  # first word of each distinct window
    limit: np.ndarray  # its words
    opening: np.ndarray  # its place in pairs, or -1 for a one-word window
    sets: list[np.ndarray]  # sets of items that have a window: those of one item, in order, and all others, each once
    set_of: np.ndarray  # of each distinct window

    @classmethod
    def of(cls, items: list[str], hashes: list[np.ndarray], window: int) -> Block:
        lengths = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype(np.uint64)
        words, symbols = np.unique(flat, return_inverse=True)
        symbols = symbols.reshape(-1).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        item_of = np.repeat(np.arange(len(items)), lengths)
        left = bounds[item_of + 1] - np.arange(len(flat))
        both, first = textscan.windows(flat, bounds, 2)
        pairs = np.unique(both)
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[pairs >> np.uint64(64 - _SIEVE_BITS)] = True
        singles = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h in hashes if len(h) == 1]]))
        whole = np.diff(np.concatenate([[-1], item_of])) != 0
        starts = np.flatnonzero((left >= window) | whole)
        begins = _window_ranks(symbols, bounds[1:][item_of], window)[starts]
        limit = np.minimum(left[starts], window)
        _, at, window_of = np.unique(begins, return_index=True, return_inverse=True)
        query = starts[at]
        opening = np.full(len(flat), -1, np.int64)
        opening[first] = np.searchsorted(pairs, both)
        own, item = np.divmod(np.unique(window_of.reshape(-1) * np.int64(len(items) + 1) + item_of[starts]), len(items) + 1)
        sets, set_of, known = [np.array([k]) for k in range(len(items))], np.zeros(len(query), np.int64), {}
        count, begin = np.bincount(own, minlength=len(query)), np.searchsorted(own, np.arange(len(query)))
        set_of[count == 1] = item[begin[count == 1]]
        for k in np.flatnonzero(count > 1):
            several = item[begin[k] : begin[k] + count[k]]
            set_of[k] = known.setdefault(several.tobytes(), len(sets))
            if set_of[k] == len(sets):
                sets.append(several)
        return cls(items, symbols, item_of, left, words, pairs, sieve, singles, window, query, limit[at], np.where(limit[at] > 1, opening[query], -1), sets, set_of)


def _doubled(rank: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Ranks of all beginnings of suffixes, each ``step`` words longer than those that ``rank`` orders; a suffix stops at its end."""
    ahead = np.arange(len(rank)) + step
    inside = ahead < ends
    key = rank * np.int64(max(len(rank), int(rank.max(initial=0))) + 1)
    key[inside] += rank[ahead[inside]]
    return np.unique(key, return_inverse=True)[1].reshape(-1) + 1


def _window_ranks(symbols: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the first ``window`` words from each word on, or of those up to its end."""
    rank, width = symbols, 1
    while width < window:
        # Where the step is shorter than the width, the two parts overlap, which orders alike.
        step = min(width, window - width)
        rank, width = _doubled(rank, ends, step), width + step
    return rank


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[Block]:
    """The benchmark's items in blocks, read from Spark partition by partition."""
    items, hashes, held = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    for item, text in rows.toLocalIterator():
        own = [part.hashes() for part in textscan.slices(pa.array([text]), textscan.ALPHANUMERIC, lower=True)]
        if held and held + len(own[0]) > block_words:
            yield Block.of(items, hashes, window)
            items, hashes, held = [], [], 0
        items.append(item)
        hashes.append(own[0])
        held += len(own[0])
    yield Block.of(items, hashes, window)


class Shard:
    """The suffix array of a batch of documents, as far as a block can match it."""

    def __init__(self, texts: pa.Array, block: Block):
        self.block = block
        texts = textscan.as_strings(texts)
        self.n_words = np.zeros(len(texts), np.int64)
        self.present = np.zeros(len(block.pairs) + 1, bool)  # pairs that the shard has; the last is for one-word windows
        self.present[-1] = True
        at, symbols, linked, base = [], [], [], 0
        for part in textscan.slices(texts, textscan.ALPHANUMERIC, lower=True):
            self.n_words[part.lo : part.hi] = np.diff(part.bounds)
            hashes = part.hashes()
            link = np.zeros(len(hashes) + 1, bool)  # link[i + 1]: words i and i + 1 may be one match
            pairs, first = textscan.windows(hashes, part.bounds, 2)
            may = np.flatnonzero(block.sieve[pairs >> np.uint64(64 - _SIEVE_BITS)])
            may = may[member(pairs[may], block.pairs)]
            self.present[np.searchsorted(block.pairs, pairs[may])] = True
            link[first[may] + 1] = True
            node = link[1:].copy()
            node |= link[:-1]
            if len(block.singles):
                node |= member(hashes, block.singles)
            index = np.flatnonzero(node)
            at.append(index + base)
            symbols.append(np.searchsorted(block.words, hashes[index]) + 1)
            linked.append(link[1:][index])
            base += len(hashes)
        empty = [np.zeros(0, np.int64)]
        self.bounds = np.concatenate([[0], np.cumsum(self.n_words)])
        self.at = np.concatenate(at or empty)
        self.symbols = np.concatenate(symbols or empty)
        # A run is a stretch of consecutive linked words; no match leaves it.
        n, stops = len(self.at), np.flatnonzero(~np.concatenate(linked or [np.zeros(0, bool)]))
        self.run_end = stops[np.searchsorted(stops, np.arange(n))] + 1 if n else np.zeros(0, np.int64)
        self.order = self.sort()

    def sort(self) -> np.ndarray:
        """The suffixes' order by as many words as a window has."""
        return np.argsort(_window_ranks(self.symbols, self.run_end, self.block.window), kind="stable")

    def common(self, node: np.ndarray, query: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that suffixes share with queries, up to a limit, and the sign of suffix against query."""
        shared, sign = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        live = np.arange(len(node))
        while len(live):
            k = shared[live]
            here, end = node[live] + k, self.run_end[node[live]]
            own = np.where(here < end, self.symbols[np.minimum(here, end - 1)], 0)
            differ = np.sign(own - self.block.symbols[query[live] + k])
            sign[live] = differ
            shared[live] += differ == 0
            live = live[(differ == 0) & (shared[live] < limit[live])]
        return shared, sign

    def search(self, query: np.ndarray, limit: np.ndarray, after: bool) -> np.ndarray:
        """The first place whose suffix is not below the query (``after``: above it)."""
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.order), np.int64)
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            _, sign = self.common(self.order[middle], query[live], limit[live])
            below = (sign < 0) | (after & (sign == 0))
            low[live[below]] = middle[below] + 1
            high[live[~below]] = middle[~below]
        return low

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Place in the array and distinct window of every occurrence; a place has one window of a length at most."""
        block = self.block
        asked = np.flatnonzero(self.present[block.opening])
        query, limit = block.query[asked], block.limit[asked]
        low, high = self.search(query, limit, False), self.search(query, limit, True)
        found = high - low
        which = np.repeat(asked, found)
        place = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
        return place, which

    def ordered(self, items: np.ndarray) -> Ordered:
        """Suffixes of the shard and, behind them, of the given items in one order."""
        words = np.flatnonzero(items[self.block.item_of])
        left, n = self.block.left[words], len(self.at)
        ends = np.concatenate([self.run_end, n + np.arange(len(words)) + left])
        rank, width = np.concatenate([self.symbols, self.block.symbols[words]]), 1
        levels = [rank]
        deep = min(int(left.max(initial=1)), int((self.run_end - np.arange(n)).max(initial=1)))
        while width < deep:
            rank, width = _doubled(rank, ends, width), 2 * width
            levels.append(rank)
        return Ordered(words, n, ends, levels)

    def occurring(self, which: np.ndarray) -> np.ndarray:
        """The items that have any of the windows."""
        items = np.zeros(len(self.block.items), bool)
        for k in np.unique(self.block.set_of[which]):
            items[self.block.sets[k]] = True
        return items

    def reach(self, place: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Words of the longest verbatim match with the benchmark at each of the places, where the windows occur."""
        if not len(place):
            return np.zeros(0, np.int64)
        both = self.ordered(self.occurring(which))
        query = both.n + np.flatnonzero(self.block.left[both.words] >= self.block.window)
        shared, _ = both.nearest(self.order[place], query)
        # A match of less than a window is none, but for a short item, which is matched as a whole.
        return np.where(shared >= self.block.window, shared, self.block.limit[which])

    def longest(self) -> list[tuple[str, int, int, int, int]]:
        """(item, first word in it, length, row, first word in the row) of each item suffix's longest match of a window at least."""
        place, which = self.occurrences()
        if not len(place):
            return []
        both = self.ordered(self.occurring(which))
        query = np.flatnonzero(self.block.left[both.words] >= self.block.window)
        shared, node = both.nearest(both.n + query, np.arange(both.n))
        start = np.concatenate([[0], np.flatnonzero(np.diff(self.block.item_of)) + 1])
        out = []
        for i in np.flatnonzero(shared >= self.block.window):
            at, word = self.at[node[i]], both.words[query[i]]
            row = int(np.searchsorted(self.bounds, at, "right")) - 1
            out.append((self.block.items[self.block.item_of[word]], int(word - start[np.searchsorted(start, word, "right") - 1]), int(shared[i]), row, int(at - self.bounds[row])))
        return out


@dataclass
class Ordered:
    """Suffixes in one order: ``n`` of a shard, then those of the benchmark's ``words``."""

    words: np.ndarray
    n: int
    ends: np.ndarray
    levels: list[np.ndarray]  # ranks by their first 1, 2, 4 ... words

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that suffixes begin with in common."""
        shared, most = np.zeros(len(a), np.int64), np.minimum(self.ends[a] - a, self.ends[b] - b)
        for k in range(len(self.levels) - 1, -1, -1):
            live = np.flatnonzero(shared < most)
            same = self.levels[k][a[live] + shared[live]] == self.levels[k][b[live] + shared[live]]
            shared[live[same]] += 1 << k
        return np.minimum(shared, most)

    def nearest(self, asked: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most words that a suffix has in common with any of the others, and that one: the next in order on either side."""
        best, found = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        if not len(among):
            return best, found
        rank = self.levels[-1]
        among = among[np.argsort(rank[among], kind="stable")]
        behind = np.searchsorted(rank[among], rank[asked], "right")
        for beside in (behind - 1, behind):
            fits = np.flatnonzero((beside >= 0) & (beside < len(among)))
            other = among[beside[fits]]
            shared = self.common(asked[fits], other)
            better = shared > best[fits]
            best[fits[better]], found[fits[better]] = shared[better], other[better]
        return best, found


def _spans(covered: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Flat [start, end, ...] word ranges of each row."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(covered))]
    cut = cut[covered[cut - 1] & covered[cut]]
    starts, ends = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    out: list[list[int]] = [[] for _ in range(len(bounds) - 1)]
    for s, e, row in zip(starts.tolist(), ends.tolist(), (np.searchsorted(bounds, starts, "right") - 1).tolist(), strict=True):
        out[row] += [s - int(bounds[row]), e - int(bounds[row])]
    return out


#: Columns that ``scan`` adds.
ADDED = ("n_words", "n_hit", "longest", "spans", "items")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text", block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with its number of words, of words hit, of words of the longest match that is a window at least, the hit word ranges and the occurring items."""
    return on_plain_names(docs, lambda plain: _scan(plain, benchmark, window, text_column, block_words, keep_text), text_column)


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, text_column: str, block_words: int, keep_text: bool) -> DataFrame:
    context = docs.sparkSession.sparkContext
    names = free_name(docs, *ADDED)
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())]
    found = docs
    coming = blocks(benchmark, block_words, window)
    block, k = next(coming), -1
    while block is not None:
        following, k = next(coming, None), k + 1
        held, last = context.broadcast(block), following is None
        inputs = found.columns
        outputs = [c for c in docs.columns if keep_text or not last or c != text_column]
        schema = T.StructType([*[docs.schema[c] for c in outputs], *[T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)]])

        def run(batches: Iterator[pa.RecordBatch], held=held, inputs=inputs, outputs=outputs, first=k == 0) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                before = None if first else [batch.column(inputs.index(name)) for name in names[2:]]
                added = hits(batch.column(inputs.index(text_column)), block, before)
                yield pa.RecordBatch.from_arrays([*[batch.column(inputs.index(c)) for c in outputs], *added], [*outputs, *names])

        found, block = found.mapInArrow(run, schema), following
        if not last:
            found = keep(found)
            held.destroy()
    return found


def hits(texts: pa.Array, block: Block, before: list[pa.Array] | None) -> list[pa.Array]:
    """The added columns of a batch; ``before`` has the last three of them from earlier blocks."""
    shard = Shard(texts, block)
    place, which = shard.occurrences()
    longest = shard.reach(place, which)
    at, bounds = shard.at[shard.order[place]], shard.bounds
    row = np.searchsorted(bounds, at, "right") - 1
    edge = np.zeros(int(bounds[-1]) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.limit[which], -1)
    most = np.zeros(len(texts), np.int64)
    items: list[list[str]] = [[] for _ in range(len(texts))]
    if before is not None:
        most, items = before[0].to_numpy().copy(), before[2].to_pylist()
        for r, spans in enumerate(before[1].to_pylist()):
            np.add.at(edge, bounds[r] + np.array(spans[::2], np.int64), 1)
            np.add.at(edge, bounds[r] + np.array(spans[1::2], np.int64), -1)
    np.maximum.at(most, row, longest)
    covered = np.cumsum(edge[:-1]) > 0
    # Windows of the same items count once a row.
    pairs = np.unique(row * np.int64(len(block.sets) + 1) + block.set_of[which])
    rows, sets = np.divmod(pairs, len(block.sets) + 1)
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    for r in np.unique(rows).tolist():
        own = np.unique(np.concatenate([block.sets[j] for j in sets[ends[r] : ends[r + 1]]]))
        items[r] += [block.items[j] for j in own.tolist()]
    return [pa.array(shard.n_words), pa.array(textscan.per_row_sum(covered, bounds)), pa.array(most), pa.array(_spans(covered, bounds), pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, id_column: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The longest verbatim match of every benchmark suffix: item, place in it, length, document, place."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), "text")
    parts = None
    for block in blocks(benchmark, block_words, least):
        held = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = Shard(batch.column(1), held.value).longest()
                ids = batch.column(0).to_pylist()
                columns = [[r[0] for r in got], [r[1] for r in got], [r[2] for r in got], [ids[r[3]] for r in got], [r[4] for r in got]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        part = keep(rows.mapInArrow(run, "item_id string, item_word long, n_words long, doc_id string, doc_word long"))
        held.destroy()
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy("item_id", "item_word").agg(F.max(F.struct("n_words", "doc_id", "doc_word")).alias("m"))
    return best.select("item_id", "item_word", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no benchmark window occurs."""

    def clean(plain: DataFrame) -> DataFrame:
        found = scan(plain, benchmark, window, block_words=block_words)
        return found.filter(F.col(free_name(plain, *ADDED)[1]) == 0).select(*plain.columns)

    return on_plain_names(docs, clean, "text")
