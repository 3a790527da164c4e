"""N-gram Jaccard self-join by a blocked sparse matrix product.

A document is a row of a sparse document by n-gram matrix. Rows that are alike are one row (a class,
named by a fingerprint of the whole set). The product of the matrix with its transpose holds the
overlaps; it is computed in blocks of rows that can have a link at all, and within a block a row's
overlaps are added up over the columns it has, against those rows only whose size is within the
bound and which are not connected to it yet. Pairs below the overlap that their two sizes demand are
discarded. So a block yields the links of a spanning forest and not all pairs of a group of copies.

Which rows can have a link: with a threshold t, a row and its partner share at least t times its
size. So a row more than n - ceil(t n) of whose n-grams are in no other row has no partner. That is
tested on the n-grams with small hashes (``SAMPLE`` of all), which are counted exactly: those of them
that are in one row only must not be that many. A row that may have a partner shares one of its first
n - ceil(t n) + 1 n-grams with it in any order that all rows use. That order is by commonness, rarest
first, then by hash, so that passages which many documents share come last. Commonness is kept in a
table of fixed size (``CELLS`` bytes), filled from the n-grams that repeat within a batch. Sample and
order decide how much work there is, never which links are found.

The product is computed twice. First each row comes once, to the block of the least of its shared
first n-grams; near copies meet there, and the links found make components. What is left are first
n-grams that rows of several components have. Where at most ``PAIR_ROWS`` rows have one, its pairs of
rows of different components are counted, and a pair stays if the first n-grams that it shares,
together with the rest of the larger set, can reach the overlap that the two sizes demand. A commoner
one's rows are a block of their own. The second product finds the links between components in these.

A block of more than ``BLOCK_ENTRIES`` entries is split by hash: in the first product every part gets
one common row, so that the copies of it stay connected; in the second each pair of parts is
multiplied. That pairing alone can grow faster than its rows, and only a first n-gram that so many
rows of several components have comes to it.

Words are runs of anything but ASCII white space, with A to Z lower-cased. N-grams are 64-bit hashes,
and so are classes.

Defined cases: null texts and texts without words have the empty set and no links; a text of fewer
words than n is one n-gram, its whole sequence; very long texts are taken whole; equal texts are
linked; rows with a null id count in components like any other, and a component of null ids only has
the id null; of repeated rows of a document that stays, the one with the least hash of all columns
stays; an empty table gives no rows; other columns, whatever their names, pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.common import free_name, keep, on_plain_names, temporary

WORDS = 5
#: The similarity, in hundredths.
THRESHOLD = 80
CELL_BITS = 22
CELLS = 1 << CELL_BITS
#: Times that an n-gram must occur in a batch for its cell to count it.
REPEATS = 3
#: Share of the hashes that are counted exactly.
SAMPLE = 0.3
BLOCK_ENTRIES = 2_000_000
#: Rows of a first n-gram whose pairs are counted; more rows are a block.
PAIR_ROWS = 32
#: Keys under which a component of several documents is looked up.
SALTS = 8
#: A sieve's bitmap has 2 to the power of these bits, least and most, by the number of wanted keys.
SIEVE_BITS = (16, 27)


def slice_sets(part: textscan.Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct n-gram, by row and then by hash."""
    hashes = part.hashes()
    grams, first = textscan.windows(hashes, part.bounds, words)
    rows = np.searchsorted(part.bounds, first, "right") - 1
    length = np.diff(part.bounds)
    short = np.flatnonzero((length > 0) & (length < words))
    whole = np.zeros(len(short), np.uint64)
    for j in range(words - 1):
        has = np.flatnonzero(length[short] > j)
        whole[has] = textscan.mix64(whole[has] + hashes[part.bounds[short[has]] + j] + np.uint64(j + 1))
    rows, grams = np.concatenate([rows, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[fresh], grams[fresh]


def fingerprints(rows: np.ndarray, grams: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each row's set; the fingerprint does not depend on the order."""
    sizes = np.bincount(rows, minlength=count)
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(textscan.mix64(grams + np.uint64(0xA5A5A5A5)), out=total[1:])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return sizes, textscan.mix64((total[ends[1:]] - total[ends[:-1]]) ^ textscan.mix64(sizes.astype(np.uint64)))


def prefix_length(sizes: np.ndarray, threshold: int) -> np.ndarray:
    return np.where(sizes > 0, sizes - -(-threshold * sizes // 100) + 1, 0)


def commonness(texts: DataFrame, words: int) -> np.ndarray:
    """A byte for each cell of n-gram hashes: 0, or from 1 the magnitude of its n-grams' count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [slice_sets(part, words)[1] for part in textscan.slices(batch.column(0), lower=True)]
            grams, counts = np.unique(np.concatenate([*grams, np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= REPEATS
            cells, of = np.unique(grams[often] >> np.uint64(64 - CELL_BITS), return_inverse=True)
            sums = np.bincount(of.reshape(-1), weights=counts[often], minlength=len(cells)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(sums)], ["cell", "n"])

    # At most CELLS rows, whatever the input.
    found = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(CELLS, np.uint8)
    table[found["cell"].to_numpy(np.int64)] = 1 + np.log2(found["n"].to_numpy(float)).astype(np.uint8)
    return table


def signatures(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """id, text_key, n, class, grams and sampled of each document.

    ``grams`` are the first n-grams in the common order, at least the prefix; the first ``sampled`` of
    them are all rare ones with small hashes. A batch gives them once for a class; further copies in
    it have none.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(commonness(rows.select("text"), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            sizes, classes, firsts, lengths, samples = [], [], [], [], []
            seen: set[int] = set()
            for part in textscan.slices(batch.column(2), lower=True):
                row, gram = slice_sets(part, words)
                count = part.hi - part.lo
                size, cls = fingerprints(row, gram, count)
                level = table[gram >> np.uint64(64 - CELL_BITS)]
                order = np.lexsort((gram, level, row))
                start = np.concatenate([[0], np.cumsum(size)])[:-1]
                sampled = np.bincount(row[(level == 0) & (gram < np.uint64(int(SAMPLE * 2**64)))], minlength=count)
                length = np.maximum(prefix_length(size, threshold), sampled)
                for k, c in enumerate(cls.tolist()):
                    if c in seen:
                        length[k] = sampled[k] = 0
                    seen.add(c)
                at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
                sizes.append(size)
                classes.append(cls)
                firsts.append(gram[order[at]])
                lengths.append(length)
                samples.append(sampled)
            if not sizes:
                continue
            n, length = np.concatenate(sizes), np.concatenate(lengths)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts).view(np.int64)))
            cls = pa.array(np.concatenate(classes).view(np.int64), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), cls, grams, pa.array(np.concatenate(samples))], ["id", "text_key", "n", "class", "grams", "sampled"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, text_key long, n long, class long, grams array<long>, sampled long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the least node that it is connected to.

    In each round a node goes to that one of itself and its neighbours which a hash of the round puts
    first, and only the edges between different ones go on. So edges shrink from round to round, on
    long paths and hubs as well, and the number of rounds grows with the logarithm of the nodes. At
    the end the rounds' choices are followed back.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct()
    left, rounds = keep(both), []
    while not left.isEmpty():
        of = lambda c, k=len(rounds): F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("root"))
        near = left.groupBy("node").agg(F.min(of("other")).alias("near"))
        went = keep(near.select("node", F.least("near", of("node"))["root"].alias("root")))
        rounds.append(went)
        ours = left.filter("node <> other").join(went, "node").select(F.col("root").alias("a"), F.col("other").alias("node")).distinct()
        left = keep(ours.join(went, "node").filter("a <> root").select(F.col("a").alias("node"), F.col("root").alias("other")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds.pop()
    for went in reversed(rounds):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = keep(went.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))


def candidates(signed: DataFrame, threshold: int) -> DataFrame:
    """(class, n, row) of the classes that may have a partner; row is one document of each.

    A class counts its sampled n-grams that no other class has; if there are more of them than a
    partner may lack, it has none. An n-gram's least and largest class are combined before they move,
    so one of many rows is no large group.
    """
    entries = signed.filter("sampled > 0").select("class", F.explode(F.slice("grams", F.lit(1), F.col("sampled").cast("int"))).alias("gram"))
    grams = entries.groupBy("gram").agg(F.min("class").alias("class"), F.max("class").alias("high")).filter(F.col("class") == F.col("high"))
    alone = grams.groupBy("class").agg(F.count(F.lit(1)).alias("alone"))
    classes = signed.filter("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.min(F.struct("text_key", "id")).alias("row"))
    allowed = F.col("n") - F.ceil(F.col("n") * threshold / 100)
    return classes.join(alone, "class", "left").filter(F.coalesce("alone", F.lit(0)) <= allowed).select("class", "n", "row")


def spanning_links(sizes: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of a block's rows, breadth first.

    The overlaps of a row with all rows that are not reached yet are a row of the sparse product:
    the postings of its columns are gathered and counted. Postings of reached rows are dropped
    whenever half of the rows have been reached since the last time.
    """
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    grams, column = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    column = column.reshape(-1)
    row = np.repeat(np.arange(len(n)), n)
    shared = np.bincount(column, minlength=len(grams))[column] > 1
    column, row = column[shared], row[shared]
    row_start = np.searchsorted(row, np.arange(len(n) + 1))
    # Rows by size: those within the size bound of row i are low[i] to high[i] - 1.
    low, high = np.searchsorted(100 * n, threshold * n), np.searchsorted(threshold * n, 100 * n, "right")
    waiting, built, links = np.ones(len(n), bool), 0, []

    def build() -> tuple[np.ndarray, np.ndarray, int]:
        left = np.flatnonzero(waiting[row])
        left = left[np.argsort(column[left], kind="stable")]
        return row[left], np.searchsorted(column[left], np.arange(len(grams) + 1)), int(waiting.sum())

    posting, start, built = build()
    for seed in range(len(n)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            own = column[row_start[i] : row_start[i + 1]]
            count = start[own + 1] - start[own]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[own], count)
            other = posting[at]
            other = other[(other >= low[i]) & (other < high[i])]
            other, overlap = np.unique(other[waiting[other]], return_counts=True)
            other = other[(100 + threshold) * overlap >= threshold * (n[i] + n[other])]
            waiting[other] = False
            queue += other.tolist()
            links += [(int(order[i]), int(order[j])) for j in other]
            if 2 * (left := int(waiting.sum())) < built:
                if not left:
                    return links
                posting, start, built = build()
    return links


def sifted(rows: DataFrame, wanted: DataFrame, key: str, among: bool = True) -> DataFrame:
    """Rows whose key may be among the wanted ones, or those whose key is surely not, by a bitmap.

    Keys are 64-bit hashes. It saves shuffling texts that the join behind it would not touch. Bits
    follow the number of wanted keys up to a bound; beyond it ever more rows may be among them.
    """
    bits = min(max((8 * wanted.count()).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])
    bucket = 1 << 15  # bits of one bitmap aggregate
    cell = F.pmod(key, F.lit(1 << bits))
    maps = wanted.select(cell.alias("cell")).groupBy(F.expr(f"cell div {bucket}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("cell") % bucket).alias("bits")).collect()
    found = np.zeros((1 << bits) // 8, np.uint8)
    for row in maps:
        found[row.bucket * bucket // 8 :][: bucket // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(found)
    place = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for batch in batches:
            at = batch.column(place).to_numpy() & ((1 << bits) - 1)
            yield batch.filter(pa.array(((found[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) == among))

    return rows.mapInArrow(run, rows.schema)


def product(docs: DataFrame, placed: DataFrame, words: int, threshold: int, block_entries: int, pairs: bool) -> DataFrame:
    """(a, b): links that connect all rows of a block which its links connect.

    ``placed`` has class, n, row and block. Small blocks are put together until they have about an
    eighth of ``block_entries``. A larger one is split; its parts get the block's least class each, or
    are multiplied pair by pair (``pairs``).
    """
    blocks = placed.groupBy("block").agg(F.sum("n").alias("entries"), F.min("class").alias("lead")).withColumn("parts", F.ceil(F.col("entries") / block_entries).cast("int"))
    blocks = keep(blocks)
    heaps = max(1, -(-8 * (blocks.agg(F.sum("entries")).first()[0] or 0) // block_entries))
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(every, lambda p: p != own) if pairs else F.when(F.col("class") == F.col("lead"), every).otherwise(F.array(own)))
    group = F.when(F.col("parts") == 1, F.pmod("block", F.lit(heaps))).otherwise(F.col("block"))
    each = placed.join(blocks, "block").withColumn("own", own).withColumn("other", F.explode(others))
    each = each.select("class", "row", F.struct(group.alias("block"), (F.least("own", "other") if pairs else F.col("other")).alias("part_a"), (F.greatest("own", "other") if pairs else F.col("other")).alias("part_b")).alias("at"))
    asked = keep(each.groupBy("class", F.col("row.text_key").alias("text_key"), F.col("row.id").alias("id")).agg(F.collect_set("at").alias("at")))

    # One key of both columns tells the wanted row from its copies. It is the join's only key, so that
    # texts are dealt by it once, for the join and for the removal of repeated rows.
    pair = F.xxhash64("text_key", "id")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")).withColumn("pair", pair)
    asked = asked.withColumn("pair", pair)
    found = sifted(texts, asked, "pair").alias("t").join(asked.alias("m"), F.expr("t.pair = m.pair AND (t.text_key ^ m.text_key) = 0 AND CASE WHEN t.id IS NULL THEN m.id IS NULL ELSE coalesce(t.id = m.id, false) END"))
    found = found.select("t.pair", "m.class", "m.at", "t.text").dropDuplicates(["pair", "class"]).select("class", "text", F.explode("at").alias("at"))

    def multiply(table: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for part in textscan.slices(table.column("text"), lower=True):
            row, gram = slice_sets(part, words)
            sets += np.split(gram, np.searchsorted(row, np.arange(1, part.hi - part.lo)))
        sizes = np.array([len(s) for s in sets], np.int64)
        cls = table.column("class").to_numpy()
        got = spanning_links(sizes, sets, threshold) if len(sets) > 1 else []
        return pa.table({"a": pa.array([int(cls[i]) for i, _ in got], pa.int64()), "b": pa.array([int(cls[j]) for _, j in got], pa.int64())})

    return found.select("class", "text", "at.*").groupBy("block", "part_a", "part_b").applyInArrow(multiply, "a long, b long")


def prefix_entries(signed: DataFrame, chosen: DataFrame, threshold: int) -> DataFrame:
    """(class, gram): the first n-grams of the chosen classes, as far as several classes have them."""
    prefix = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    given = signed.filter(F.size("grams") > 0).select("class", F.slice("grams", F.lit(1), prefix.cast("int")).alias("grams"))
    # Copies in several batches give a class's n-grams several times.
    once = sifted(given, chosen, "class").join(chosen.select("class"), "class").dropDuplicates(["class"])
    # Dealt by n-gram once: the counts read the same columns as the rows that they are joined with.
    entries = keep(once.select("class", F.explode("grams").alias("gram"))).repartition("gram")
    held = entries.groupBy("gram").agg(F.count("class").alias("classes")).filter("classes > 1")
    return keep(entries.join(held, "gram").select("class", "gram"))


def between(entries: DataFrame, roots: DataFrame, chosen: DataFrame, threshold: int) -> DataFrame:
    """(class, block): rows of different components that may have a link.

    ``entries`` are those of ``prefix_entries`` and ``roots`` the (node, root) of the links so far.
    """
    rooted = entries.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = keep(rooted).repartition("gram")
    mixed = rooted.groupBy("gram").agg(F.count("class").alias("classes"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    rows = keep(rooted.join(mixed.select("gram", "classes"), "gram").join(chosen.select("class", "n"), "class"))
    # At most PAIR_ROWS rows an n-gram come together here.
    few = rows.filter(F.col("classes") <= PAIR_ROWS).groupBy("gram").agg(F.collect_list(F.struct("class", "root", "n")).alias("own"))
    each = few.select(F.explode("own").alias("x"), "own").select("x", F.explode("own").alias("y"))
    near = F.expr(f"x.class < y.class AND x.root <> y.root AND 100 * least(x.n, y.n) >= {threshold} * greatest(x.n, y.n)")
    counted = each.filter(near).groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count(F.lit(1)).alias("shared"))
    # Behind the first n-grams of the larger set there are ceil(t n) - 1 more.
    reach = F.col("shared") + F.ceil(F.greatest("na", "nb") * threshold / 100) - 1
    pairs = counted.filter((100 + threshold) * reach >= threshold * (F.col("na") + F.col("nb")))
    pairs = keep(pairs.select("a", "b"))
    many = rows.filter(F.col("classes") > PAIR_ROWS).select("class", F.col("gram").alias("block"))
    return pairs.select(F.col("a").alias("class"), F.col("a").alias("block")).union(pairs.select(F.col("b").alias("class"), F.col("a").alias("block"))).union(many).distinct()


def joined_components(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further links between the components of ``roots``."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y"))
    ends = keep(ends)
    met = keep(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
    alone = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = roots.unionByName(alone)
    return every.join(met.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))


def links(docs: DataFrame, signed: DataFrame, words: int, threshold: int, block_entries: int = BLOCK_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes that connect all classes which are connected at all, and their components (node, root)."""
    chosen = keep(candidates(signed, threshold))
    entries = prefix_entries(signed, chosen, threshold)
    homes = entries.groupBy("class").agg(F.min("gram").alias("block")).join(chosen, "class")
    first = keep(product(docs, keep(homes), words, threshold, block_entries, False))
    roots = keep(components(first))
    left = keep(between(entries, roots, chosen, threshold))
    if left.isEmpty():
        return first, roots
    second = keep(product(docs, keep(left.join(chosen, "class")), words, threshold, block_entries, True))
    return first.unionByName(second), keep(joined_components(roots, second))


def join(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """id, text_key, n, class, component and first of each document.

    ``component`` is null for the empty set. ``least`` is the component's smallest id, ``first`` is
    true for the rows of the one document that stands for the component: that id's, and of several
    texts under it (or of null ids) the one with the least key.
    """
    with temporary():
        signed = keep(signatures(docs, words, threshold))
        _, roots = links(docs, signed, words, threshold, block_entries)
        rows = signed.select("id", "text_key", "n", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("root", "class"))
        rows = keep(rows.select("id", "text_key", "n", "class", "component"), outlive=True)
    heads = rows.filter("component IS NOT NULL").groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("head"))
    # Only components of several rows are looked up, each under SALTS keys, so that a large one is dealt to several tasks.
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    several = heads.filter("rows > 1").select("component", "least", "head", salt)
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "text_key"), F.lit(SALTS)).cast("int")).join(several, ["component", "salt"], "left")
    first = F.col("head").isNull() | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_key") == F.col("head.text_key")))
    return joined.select("id", "text_key", "n", "class", "component", F.coalesce("least", F.when(F.col("component").isNotNull(), F.col("id"))).alias("least"), (F.col("component").isNotNull() & first).alias("first"))


def deduplicate(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, and all documents with the empty set.

    Documents that go, and those that the table repeats, are few: only rows that may be of them are
    shuffled, and all others pass. Of a repeated document that stays, one row does.
    """
    return on_plain_names(docs, lambda plain: _deduplicate(plain, words, threshold), "doc_id", "text")


def _deduplicate(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    key, ident, first = free_name(docs, "text_key", "id", "first")
    states = join(docs, words, threshold).filter("n > 0").groupBy("id", "text_key").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("rows"))
    special = keep(states.filter("NOT first OR rows > 1").select(F.col("id").alias(ident), F.col("text_key").alias(key), F.col("first").alias(first)))
    rows = docs.withColumn(key, F.xxhash64("text"))
    joined = sifted(rows, special, key).alias("d").join(special.alias("s"), F.expr(f"d.`{key}` = s.`{key}` AND d.doc_id <=> s.`{ident}`"), "left").select("d.*", f"s.{first}")
    # Rows that differ in other columns only: the least by a hash of all of them, the same in every run.
    once = joined.filter(F.col(first)).groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(F.to_json(F.struct(*docs.columns)))).alias("row")).select("row.*")
    parts = [sifted(rows, special, key, among=False), joined.filter(F.col(first).isNull()), once]
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))
