"""Line dedup by pairwise alignment of overlapping documents.

Lines are hashed with their outer white space removed. A stretch of lines of a
document that all occur in other documents too, and that holds ``min_words``
words or more, may repeat another document. Each of its lines is looked up at
the earliest document that has it, and so is each shortest window of lines that
reaches ``min_words`` words, from its first line on or back from its last: a
passage of that length consists of such windows, so all of it is held by the
partners, also where its lines come from different documents. That gives at most
three pairs a line, whatever the number of documents that share it, and each
pair (later document, earlier document) is aligned once, in one task, over the
line hashes alone.

The alignment is patience diff: lines that occur once in both are matched along
a longest increasing subsequence, matches grow over their equal neighbours, and
what lies between is aligned the same way. Aligned common blocks of
``min_words`` words are deleted from the later document; the rest is aligned
again until no block is found. Short lines that cross a passage can keep it out
of every alignment, so a suffix automaton of the earlier document then finds the
common runs of ``min_words`` words that still have an unmatched line, in any
order, and these are deleted too. A shorter run is kept, so common short lines
stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HOT, Workspace, lists, spread_join, utf8

MIN_WORDS = 50


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, lines, words, text_hash): the hash and the number of words of each line; blank lines hash to 0, an empty text has no line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            data = data.tobytes()
            hashes, words, ends = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                for line in data[a:b].split(b"\n") if b > a else ():
                    line = line.strip()
                    hashes.append(xxhash.xxh3_64_intdigest(line) if line else 0)
                    words.append(len(line.split()))
                ends.append(len(hashes))
            ends = np.array(ends, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.array(hashes, np.uint64).view(np.int64), ends, pa.int64()), lists(np.array(words, np.int32), ends, pa.int32()), batch.column(2)], names=["doc_id", "lines", "words", "text_hash"])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(run, "doc_id long, lines array<long>, words array<int>, text_hash long")


def windows(lines: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Hashes of the shortest windows of ``min_words`` words that start, or end, at each line that is not blank."""
    sums, at = np.concatenate([[0], np.cumsum(words, dtype=np.int64)]), np.flatnonzero(lines)
    ends = np.searchsorted(sums, sums[at] + min_words)
    starts = np.searchsorted(sums, sums[at + 1] - min_words, "right") - 1
    forth, back = ends < len(sums), starts >= 0
    spans = {*zip(at[forth].tolist(), ends[forth].tolist(), strict=True), *zip(starts[back].tolist(), (at[back] + 1).tolist(), strict=True)}
    return np.array(sorted({xxhash.xxh3_64_intdigest(lines[a:b].tobytes()) for a, b in spans}), np.uint64).view(np.int64)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, in order of their first, whose seconds increase (patience sorting)."""
    tops, piles, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched (index in a, index in b), both increasing; lines of hash 0 or None match only as neighbours of a match."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _increasing([(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if x and in_a[x] == 1 and x in where])
        if not anchors:
            # Nothing is unique: the first line that both have anchors, if any.
            first = {}
            for j in range(b1 - 1, b0 - 1, -1):
                first[b[j]] = j
            anchors = next(([(i, first[a[i]])] for i in range(a0, a1) if a[i] and a[i] in first), [])
            if not anchors:
                continue
        i, j = a0, b0
        for p, q in [*anchors, (a1, b1)]:
            if p < i or q < j:
                continue  # grown over already
            # Between the last match and this anchor: grow back from the anchor, then align what is left.
            end_a, end_b = p, q
            while end_a > i and end_b > j and a[end_a - 1] == b[end_b - 1] and a[end_a - 1] is not None:
                end_a, end_b = end_a - 1, end_b - 1
                out.append((end_a, end_b))
            work.append((i, end_a, j, end_b))
            while p < a1 and q < b1 and a[p] == b[q] and a[p] is not None:
                out.append((p, q))
                p, q = p + 1, q + 1
            i, j = p, q
    return sorted(out)


def common_runs(later: list[int], earlier: list[int]) -> Iterator[tuple[int, int]]:
    """(first line, lines) of each run of ``later`` that ``earlier`` has too and that is in no longer such run."""
    # Suffix automaton of the earlier document: transitions, suffix link and longest length of each state.
    to, link, size, last = [{}], [-1], [0], 0
    for x in earlier:
        new, p = len(to), last
        to.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and x not in to[p]:
            to[p][x] = new
            p = link[p]
        if p >= 0:
            q = to[p][x]
            if size[q] > size[p] + 1:
                copy = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                link[q] = copy
                while p >= 0 and to[p].get(x) == q:
                    to[p][x] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    # The longest run that ends at each line; it goes out when the next line does not lengthen it.
    at = n = 0
    for k, x in enumerate(later):
        if x not in to[at]:
            if n:
                yield k - n, n
            while at >= 0 and x not in to[at]:
                at = link[at]
            at, n = (at, size[at]) if at >= 0 else (0, -1)
        at, n = to[at].get(x, 0), n + 1
    if n:
        yield len(later) - n, n


def common_blocks(later: list[int], words: list[int], earlier: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first line, lines) of the blocks of ``later`` to delete: all lines of its common runs of ``min_words`` words; blocks may overlap."""
    left, found = list(later), []
    while True:
        matched = patience(left, earlier)
        blocks, k = [], 0
        while k < len(matched):
            end = k + 1
            while end < len(matched) and matched[end][0] == matched[end - 1][0] + 1 and matched[end][1] == matched[end - 1][1] + 1:
                end += 1
            first, n = matched[k][0], end - k
            if sum(words[first : first + n]) >= min_words:
                blocks.append((first, n))
            k = end
        if not blocks:
            break
        for first, n in blocks:
            left[first : first + n] = [None] * n
        found += blocks
    # Is there a stretch of lines of the earlier document, long enough and with an unmatched line?
    has, total, unmatched = set(earlier), 0, False
    for k, x in enumerate(later):
        total, unmatched = (total + words[k], unmatched or left[k] is not None) if x in has else (0, False)
        if unmatched and total >= min_words:
            break
    else:
        return sorted(found)
    # As few runs as hold all those lines: of the runs with the next one, the last, which reaches furthest.
    sums, after = [0], [len(later)] * (len(later) + 1)
    for w in words:
        sums.append(sums[-1] + w)
    for k in range(len(later) - 1, -1, -1):
        after[k] = after[k + 1] if left[k] is None else k
    runs = [(first, first + n) for first, n in common_runs(later, earlier) if sums[first + n] - sums[first] >= min_words]
    done = 0
    for k, (first, end) in enumerate(runs):
        need = after[max(first, done)] if done < end else end
        if need < end and (k + 1 == len(runs) or runs[k + 1][0] > need):
            found.append((first, end - first))
            done = end
    return sorted(found)


def repeated_blocks(docs: DataFrame, min_words: int = MIN_WORDS, work: Workspace | None = None) -> DataFrame:
    """(doc_id, text_hash, from_doc, first_line, n_lines, n_words) of each aligned common block of a later document.

    ``docs`` has columns doc_id and text. Documents with null or empty text or a
    null doc_id have no block. Rows that repeat a doc_id are one document, the
    one whose lines are least.
    """
    work = work or Workspace(docs.sparkSession)
    table = line_table(docs.where("doc_id is not null and text is not null"))
    table = work.keep(table, "line_table")
    again = table.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if not again.isEmpty():
        least = table.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lines", "words", "text_hash")).alias("m")).select("doc_id", "m.*")
        table = work.keep(table.join(again, "doc_id", "left_anti").unionByName(least), "table")
    each = table.select("doc_id", F.posexplode(F.arrays_zip("lines", "words")).alias("at", "line")).select("doc_id", "at", F.col("line.lines").alias("hash"), F.col("line.words").alias("words"))
    seen = each.where("hash <> 0").groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    seen = work.keep(seen.where("owner < last").drop("last"), "seen")
    # Blank lines, often the most frequent ones, are in no join.
    shared = each.where("hash <> 0").join(seen, "hash").unionByName(each.where("hash = 0").withColumn("owner", F.lit(None).cast("long")))
    # Stretches of shared (or blank) lines: those with as many unshared lines before them.
    order = Window.partitionBy("doc_id").orderBy("at")
    stretch = shared.withColumn("stretch", F.col("at") - F.row_number().over(order))
    stretch = stretch.withColumn("total", F.sum("words").over(Window.partitionBy("doc_id", "stretch"))).where(F.col("total") >= min_words)
    whole = stretch.groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "words", "owner"))).alias("l"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each line's owner and each window of a stretch."""
        for batch in batches:
            for doc, lines, words, owners in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = np.array(sorted({x for x in owners if x is not None and x < doc}), np.int64)
                found = windows(np.array(lines, np.int64), np.array(words, np.int64), min_words)
                n = len(own) + len(found)
                if n:
                    is_owner = np.arange(n) < len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.concatenate([own, found])), pa.array(is_owner)], names=["doc_id", "value", "is_owner"])

    looked = whole.select("doc_id", "l.hash", "l.words", "l.owner").mapInArrow(look, "doc_id long, value long, is_owner boolean")
    looked = work.keep(looked, "looked")
    held = looked.where("not is_owner").groupBy("value").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    # Written on its own, so that Spark can split a frequent window's side of the join.
    held = work.keep(held, "held")
    by_window = looked.where("not is_owner").join(held, "value").where("owner < doc_id").select("doc_id", "owner")
    pairs = looked.where("is_owner").select("doc_id", F.col("value").alias("owner")).unionByName(by_window).distinct()
    pairs = work.keep(pairs, "pairs")
    # A document may own what very many others repeat.
    owners = table.select(F.col("doc_id").alias("owner"), F.col("lines").alias("owner_lines"))
    both = spread_join(pairs, owners, "owner", work, "owners", HOT).join(table, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):  # one pair's lines at a time
                doc, text, owner, later, words, earlier = (c[k].as_py() for c in batch.columns)
                out += [(doc, text, owner, first, n, sum(words[first : first + n])) for first, n in common_blocks(later, words, earlier, min_words)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "text_hash", "from_doc", "first_line", "n_lines", "n_words"])

    return both.select("doc_id", "text_hash", "owner", "lines", "words", "owner_lines").mapInArrow(run, "doc_id long, text_hash long, from_doc long, first_line int, n_lines int, n_words int")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text without the repeated blocks, n_removed (lines), blocks.

    ``blocks`` are (from_doc, first_line, n_lines, n_words), in order; lines count
    from 0 and may be in several blocks. Null text stays null, empty text empty.
    Rows without a doc_id lose nothing; rows that repeat one are one document to
    the search (see ``repeated_blocks``), and a repeated row whose text is another
    one is left whole. Other columns of ``docs`` are not read; an empty table
    gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    work = Workspace(docs.sparkSession)
    blocks = work.keep(repeated_blocks(source, min_words, work), "blocks")
    blocks = blocks.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text")).agg(F.array_sort(F.collect_list(F.struct("first_line", "from_doc", "n_lines", "n_words"))).alias("blocks"))
    same = (source.doc_id == blocks.of) & (F.xxhash64(source.text) == blocks.of_text)
    joined = source.join(blocks.hint("shuffle_hash"), same, "left").withColumn("lines", F.split("text", "\n", -1))
    # The stretches between the blocks, which are in order of their first line.
    start = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("kept"), F.lit(0).alias("at"))

    def step(acc: Column, b: Column) -> Column:
        between = F.struct(acc.at.alias("at"), (b.first_line - acc.at).alias("n"))
        return F.struct(F.when(b.first_line > acc.at, F.array_append(acc.kept, between)).otherwise(acc.kept).alias("kept"), F.greatest(acc.at, b.first_line + b.n_lines).alias("at"))

    rest = F.aggregate("blocks", start, step, lambda acc: F.array_append(acc.kept, F.struct(acc.at.alias("at"), F.lit(1 << 30).alias("n"))))
    kept = F.flatten(F.transform(rest, lambda x: F.slice("lines", x.at + 1, x.n)))
    cut = joined.withColumn("kept", F.when(F.col("blocks").isNotNull(), kept))
    return cut.select(
        "doc_id",
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).alias("n_removed"),
        "blocks",
    )
