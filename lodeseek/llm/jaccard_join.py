"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document is the set of hashes of its word shingles. All sets are put in
one order, rarest shingle first, by a sketch of the shingle counts of the whole
table. A set of n shingles whose partners must share at least o = ceil(t*n) of
them has the l-prefix of its first n - o + l shingles, and two sets that reach
the threshold share at least min(l, l') shingles of their prefixes. Each
document takes the l whose estimated cost is least: a longer prefix reads more
postings but lets fewer candidates through to verification, because they must
share more of it.

Documents with equal sets are one class from the start. Links between classes
are found in rounds that never emit the pairs of a group:

* star rounds compare the members of each prefix shingle's posting list with
  its most central member, and join what links into components;
* posting lists whose members are all in one component are done;
* the last round compares, in the lists that remain, each member outside the
  list's largest component with the members of other components, in the first
  list that both are in, and counts the prefix shingles that such a pair shares
  before it is verified. Only this round is needed for exactness; the star
  rounds leave it little to do.

Parity bitmaps of the sets (odd sketches), in which two sets differ in no more
bits than in shingles, drop most pairs that cannot reach the threshold before
whole sets are fetched, and in long lists inside the join, before there is a row
for the pair. A parity bit tells sets apart however large they are, because what
they have in common cancels out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import Workspace, WordHasher, lists, longs, mix, shingle_hashes, slices, utf8

#: log2 of the sketch's counters, and counters a block; the broadcast sketch has one byte a counter.
SKETCH_BITS = 24
BLOCK = 1 << 14
#: Weight of verifying a candidate against reading a posting, and the longest extension of a prefix that is tried.
VERIFY_COST = 2.0
LONGEST = 32
#: Star rounds stop when the inter-component pairs left are fewer than this many a posting, or after so many rounds.
FEW_PAIRS = 8.0
ROUNDS = 4
#: 64-bit words of a set's bitmap, and how long a list must be for its members to carry it.
BITMAP = 16
LONG_LIST = 8
#: Lists of a set before each one that are looked at to meet another set once only.
BEFORE = 4
#: Pairs with one set that a task verifies.
HOT = 256


def _sets(batch: pa.RecordBatch, hasher: WordHasher, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text (column 1)."""
    data, offsets = utf8(batch.column(1))
    for a, b in slices(offsets):
        h, _, _, first = hasher.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i, j in zip(first[:-1], first[1:], strict=True):
            yield np.unique(shingle_hashes(h[i:j], k))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, sig0, sig1) of each row: the set's size and a 128-bit hash of the set.

    Each task adds rows (block, counts) of its shingle counts, the others null:
    one pass over the texts gives both. Null and empty texts have size 0; repeated
    rows are counted each; an empty table has no row.
    """
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(), np.zeros(size, np.uint16)
        for batch in batches:
            n, s0, s1 = [], [], []
            for x in _sets(batch, hasher, k):
                n.append(len(x))
                s0.append(x.sum(dtype=np.uint64))
                s1.append(mix(x).sum(dtype=np.uint64))
                at = (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                np.add.at(counts, at[counts[at] < 65_000], np.uint16(1))  # so common in a task: common enough
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(longs(np.array(s0, np.uint64))), pa.array(longs(np.array(s1, np.uint64)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=_SIGNED)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        nulls = [pa.nulls(len(used), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(used, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in used], pa.binary())], schema=_SIGNED)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig0 long, sig1 long, block int, counts binary")


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig0", pa.int64()), ("sig1", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def count_sketch(signed: DataFrame) -> np.ndarray:
    """Quarter-log2 counts of the shingles of all documents by the top bits of their hash, one byte each.

    The size is fixed, so it can be broadcast whatever the corpus. Counts of
    different shingles may share a counter: that changes the order of shingles,
    and so the work, but no result.
    """

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for x in batch.column(1):
                counts += np.frombuffer(zlib.decompress(x.as_py()), np.uint16)
        logs = np.round(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([logs.tobytes()], pa.binary())], names=["block", "counts"])

    sums = signed.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(total, "block int, counts binary")
    out = np.zeros(((1 << SKETCH_BITS) // BLOCK, BLOCK), np.uint8)
    for row in sums.collect():  # 2**SKETCH_BITS bytes at most
        out[row.block] = np.frombuffer(row.counts, np.uint8)
    return out.reshape(-1)


def prefix(values: np.ndarray, logs: np.ndarray, others: np.ndarray, percent: int) -> tuple[int, np.ndarray, float]:
    """(l, the l-prefix, how common it is) of a sorted set; ``others`` estimates from ``logs`` in how many other sets a shingle is."""
    n = len(values)
    need = -(-n * percent // 100)
    logs = logs[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(logs, kind="stable")
    most = min(LONGEST, need)
    postings = np.cumsum(others[logs[order[: n - need + most]]])[n - need :]
    lengths = np.arange(1, most + 1)
    # A candidate shares at least l of the postings read.
    best = int(np.argmin(postings + VERIFY_COST * postings / lengths + 0.01 * lengths)) + 1
    taken = order[: n - need + best]
    return best, values[taken], float(logs[taken].mean())


def prefixes(docs: DataFrame, k: int, percent: int, logs: np.ndarray) -> DataFrame:
    """(doc_id, n, l, central, tokens) of each row with a shingle (null, empty and white texts have none); ``central``: how common its prefix is."""
    cast = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, logs = WordHasher(), cast.value
        # What any counter holds of other shingles is no sign of a common one.
        floor = 2.0 ** (np.median(logs) / 4)
        others = np.maximum(2.0 ** (np.arange(256) / 4) - floor, 0)
        for batch in batches:
            ids, n, l, central, tokens, ends, at = [], [], [], [], [], [], 0
            for i, x in zip(batch.column(0).to_pylist(), _sets(batch, hasher, k), strict=True):
                if len(x):
                    best, taken, common = prefix(x, logs, others, percent)
                    at += len(taken)
                    ids.append(i)
                    n.append(len(x))
                    l.append(best)
                    central.append(common)
                    tokens.append(longs(taken))
                    ends.append(at)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(l, pa.int32()), pa.array(central, pa.float32()), lists(np.concatenate(tokens), np.array(ends), pa.int64())], names=["doc_id", "n", "l", "central", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n int, l int, central float, tokens array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, shingles, bits) with each row's sorted distinct shingle hashes, their number and parity bitmap."""

    def bitmap(x: np.ndarray) -> np.ndarray:
        """A bit for each place: whether an odd number of shingles falls there."""
        odd = np.bincount((x % np.uint64(BITMAP * 64)).astype(np.int64), minlength=BITMAP * 64) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = list(_sets(part, hasher, k))
                bits = np.concatenate([bitmap(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int32()), lists(longs(np.concatenate(found)), np.cumsum([len(x) for x in found]), pa.int64()), lists(bits, np.arange(1, len(found) + 1) * BITMAP, pa.int64())], names=["doc_id", "n", "shingles", "bits"])

    return docs.mapInArrow(run, "doc_id long, n int, shingles array<long>, bits array<long>")


def _near(n0: str, n1: str, words: list[tuple], percent: int):
    """Whether two sets may reach the threshold by their bitmaps: sets differ in as many shingles as parity bitmaps in bits, or more.

    100 * |x & y| >= percent * |x | y| leaves at most (100 - percent) / (100 + percent) of all shingles unshared.
    """
    differ = reduce(add, (F.bit_count(x.bitwiseXOR(y)) for x, y in words))
    return differ * (100 + percent) <= (F.col(n0) + F.col(n1)) * (100 - percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, work: Workspace, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold; bitmaps are compared first, then what is left as a whole.

    Many pairs may have the same b, the centre of a family: its set is sent to
    as many tasks as it has ``HOT`` pairs, each of which gets a part of them.
    """
    pairs = work.keep(pairs.select("a", "b"), f"{name}_pairs")
    hot = work.keep(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("salts")).where("salts > 1"), f"{name}_hot")
    words = [(F.get(F.col("bits"), F.lit(i)), F.get(F.col("bits2"), F.lit(i))) for i in range(BITMAP)]
    shared = F.size(F.array_intersect("shingles", "shingles2"))
    enough = shared * 100 >= (F.col("n") + F.col("n2") - shared) * percent

    def sides(found: DataFrame, ends: DataFrame | None, *columns: str) -> DataFrame:
        """``found`` (a, b) with columns of both sets, those of b named with a 2; ``ends`` are the (b, salt) of salted pairs."""
        own = sets.select(F.col("doc_id").alias("a"), *columns)
        other = sets.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"{c}2") for c in columns))
        return found.join(own, "a").join(other, "b") if ends is None else found.join(own, "a").join(ends.join(other, "b"), ["b", "salt"])

    def checked(found: DataFrame, ends: DataFrame | None) -> DataFrame:
        near = sides(found, ends, "n", "bits").where(_near("n", "n2", words, percent)).select(*found.columns)
        if ends is not None:
            near = work.keep(near, f"{name}_near")
            ends = near.select("b", "salt").distinct()
        return sides(near, ends, "n", "shingles").where(enough).select("a", "b")

    if hot.isEmpty():
        return checked(pairs, None)
    salted = pairs.join(hot, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    ends = hot.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return checked(pairs.join(hot, "b", "left_anti"), None).unionByName(checked(salted, ends))


def _possible(n0: str, n1: str, at0: str, at1: str, percent: int):
    """Whether two sets of these sizes, with the same shingle at these places of the common order, may reach the threshold.

    They share no more before it than the lesser place, and no more after it than the lesser rest.
    """
    most = F.least(at0, at1) + 1 + F.least(F.col(n0) - F.col(at0), F.col(n1) - F.col(at1)) - 1
    return (F.least(n0, n1) * 100 >= F.greatest(n0, n1) * percent) & (most * (100 + percent) >= (F.col(n0) + F.col(n1)) * percent)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * |x & y| >= percent * |x | y| for their sets of
    ``k``-word shingles; ``component_id`` is the smallest doc_id that links
    reach. A document with fewer than ``k`` words has its whole word sequence
    as its one shingle; one without words, or with null text, has none, links
    with nothing and is its own component. Rows that repeat a doc_id are one
    node of the graph, which has the links of each of them. A null doc_id takes
    no part: its row has a null component. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    work = Workspace(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = work.keep(signatures(source, k), "signed")
    key = ["n_shingles", "sig0", "sig1"]
    rows = signed.where("block is null")
    known = rows.where("doc_id is not null and n_shingles > 0")
    classes = work.keep(known.groupBy(*key).agg(F.min("doc_id").alias("doc_id")), "classes")
    twins = known.join(classes.withColumnRenamed("doc_id", "a"), key).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    links = _class_links(source, classes.select("doc_id").distinct(), count_sketch(signed), k, percent, work)
    roots = components(links.unionByName(twins), work)
    out = rows.join(roots, rows.doc_id == roots.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _class_links(source: DataFrame, classes: DataFrame, logs: np.ndarray, k: int, percent: int, work: Workspace, log=None) -> DataFrame:
    """Links (a, b) that join all classes which links connect."""
    heads = prefixes(source, k, percent, logs).join(classes, "doc_id", "left_semi")
    postings = work.keep(heads.select("doc_id", "n", "l", "central", F.posexplode("tokens").alias("pos", "token")), "postings")
    common = work.keep(postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "common")
    shared = work.keep(postings.join(common, "token"), "shared")
    work.drop("postings", "common")
    members = shared.select("doc_id").distinct()
    sets = work.keep_bucketed(shingle_sets(source.join(members.hint("shuffle_hash"), "doc_id", "left_semi"), k), "sets", "doc_id")
    empty = source.sparkSession.createDataFrame([], "a long, b long")
    links, left, size = empty, shared.withColumn("root", F.col("doc_id")), None
    for step in range(ROUNDS):
        # The list's most central member, of the components but the largest one's after the first round.
        rank = F.struct("central", (-F.col("doc_id")).alias("order"), F.col("n").alias("pn"), F.col("l").alias("pl"), F.col("root").alias("proot"), F.col("pos").alias("ppos"))
        who = left.where("not largest") if step else left
        # Written on its own, so that Spark can split a long list's side of the join.
        pivot = work.keep(who.groupBy("token").agg(F.max(rank).alias("p")), f"pivot_{step}")
        pairs = left.join(pivot, "token").where("root <> p.proot").where(_possible("n", "p.pn", "pos", "p.ppos", percent)).select("doc_id", F.expr("-p.order").alias("pivot"), F.least("l", "p.pl").alias("l"))
        pairs = pairs.groupBy(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("l").alias("l")).where("c >= l")
        links = work.keep(links.unionByName(_verified(pairs, sets, percent, work, f"star_{step}")), f"links_{step}")
        work.drop(f"star_{step}_pairs", f"star_{step}_hot", f"star_{step}_near", f"pivot_{step}")
        left, pairs_left, rows_left = _unfinished(shared, links, work, step)
        if log:
            log(step, pairs_left, rows_left)
        if pairs_left <= FEW_PAIRS * rows_left or (size is not None and pairs_left > 0.9 * size):
            break
        size = pairs_left
    # Exact: every pair of different components in a list, met from the member outside the largest.
    long, words = left.where(F.col("all") > LONG_LIST), [f"w{i}" for i in range(BITMAP)]
    maps = sets.join(long.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *(F.col("bits")[i].alias(w) for i, w in enumerate(words)))
    left = long.join(maps, "doc_id").unionByName(left.where(F.col("all") <= LONG_LIST).withColumns({w: F.lit(None).cast("long") for w in words}))
    # Two sets meet in every list that both are in; where one of the lists before has both, they have met already.
    order = Window.partitionBy("doc_id").orderBy("pos")
    left = left.withColumn("before", F.array_compact(F.array(*(F.lag("token", i).over(order) for i in range(1, BEFORE + 1)))))
    left = work.keep(left.select("token", "doc_id", "n", "pos", "root", "largest", "before", *words), "left")
    x, y = left.where("not largest").alias("x"), left.alias("y")
    near = F.coalesce(_near("x.n", "y.n", [(F.col(f"x.{w}"), F.col(f"y.{w}")) for w in words], percent), F.lit(True))
    met = F.expr("x.token = y.token and x.root <> y.root and (y.largest or x.doc_id < y.doc_id)")
    pairs = x.join(y, met & _possible("x.n", "y.n", "x.pos", "y.pos", percent) & ~F.arrays_overlap("x.before", "y.before") & near)
    pairs = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    pairs = _matched(pairs, shared, work)
    links = work.keep(links.unionByName(_verified(pairs, sets, percent, work, "exact")), "links")
    work.drop("sets", "met", "heads", "left")
    return links


def _matched(pairs: DataFrame, shared: DataFrame, work: Workspace) -> DataFrame:
    """Those of the pairs (a, b) that share as many prefix shingles as the shorter extension of their prefixes asks for; others are not verified.

    Each document's prefix comes once, and a pair stays one row. A doc_id with
    several texts has all their shingles and the least extension.
    """
    pairs = work.keep(pairs, "met")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    heads = work.keep(shared.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("token").alias("tokens"), F.min("l").alias("l")), "heads")
    one, two = (heads.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"tokens_{x}"), F.col("l").alias(f"l_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    return both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.least("l_a", "l_b")).select("a", "b")


def _unfinished(shared: DataFrame, links: DataFrame, work: Workspace, step: int) -> tuple[DataFrame, int, int]:
    """The postings of lists with two components or more, how many pairs of different components they hold, and their number."""
    roots = components(links, work, f"roots_{step}")
    rooted = shared.join(roots, shared.doc_id == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "doc_id"))
    rooted = work.keep(rooted, f"rooted_{step}")
    parts = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    lists_ = parts.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("within")).where("parts > 1")
    lists_ = work.keep(lists_.select("token", F.col("most.root").alias("main"), ((F.col("all") * F.col("all") - F.col("within")) / 2).alias("pairs"), "all"), f"lists_{step}")
    counts = lists_.agg(F.sum("pairs"), F.sum("all")).first()
    left = rooted.join(lists_.select("token", "main", "all"), "token").withColumn("largest", F.col("root") == F.col("main"))
    return left, counts[0] or 0, counts[1] or 0


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, whose doc_id is the smallest of its component, or null.

    Cases are as in ``jaccard_components``; repeated rows of a kept id all stay.
    """
    found = jaccard_components(docs, k, percent, id_col, text_col)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone.gone, "left_anti")
