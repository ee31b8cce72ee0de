"""Edit-aware token counts: a segment tree of pre-token counts per document.

A document's text is cut into leaves at places where a pre-token always ends (a
space or line feed after a character that is not white space), so the leaves'
token counts add up to the document's. Leaves and the sums above them, of
characters and of tokens, are stored as a tree. An edit finds its leaf by the
sums, without reading the rest, and changes that leaf alone, or its neighbour too
where it touches the place between them. Only the new text of such leaves is
encoded, once a batch of documents, and only the sums above them change: a leaf
that grew is split below its own node, and a tree that became too deep is built
anew from its leaves' counts, which costs as many sums as the edits that made it
so deep.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CachedEncoder, Workspace

LEAF = 384
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_SAFE = re.compile(r"\S[ \n]")


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """``text`` in leaves: each ends at the first safe place after ``leaf`` characters."""
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + leaf)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    """Nodes in preorder: characters and tokens below each, and the right child's place (0 for a leaf; the left child comes next).

    Nodes that an edit adds stand at the end, and ``left`` has their left
    children. ``encoded`` and ``touched`` count the characters that were encoded
    and the sums that were changed.
    """

    def __init__(self, chars: list[int], tokens: list[int], right: list[int]):
        self.chars, self.tokens, self.right, self.left = chars, tokens, right, {}
        self.encoded = self.touched = 0
        self.dirty: dict[int, tuple[str, tuple[int, ...]]] = {}  # leaf: its text, and the nodes above it

    @classmethod
    def of(cls, lengths: list[int], counts: list[int]) -> CountTree:
        """A balanced tree of leaves with these characters and tokens."""
        tree = cls([], [], [])
        tree._add(lengths, counts, 0, len(lengths))
        return tree

    def _add(self, lengths: list[int], counts: list[int], a: int, b: int) -> int:
        """Append the nodes of leaves ``a`` to ``b``; the place of their root."""
        at = len(self.chars)
        self.chars.append(lengths[a] if b - a == 1 else 0)
        self.tokens.append(counts[a] if b - a == 1 else 0)
        self.right.append(0)
        if b - a > 1:
            middle = (a + b + 1) // 2
            self._add(lengths, counts, a, middle)
            right = self.right[at] = self._add(lengths, counts, middle, b)
            self.chars[at] = self.chars[at + 1] + self.chars[right]
            self.tokens[at] = self.tokens[at + 1] + self.tokens[right]
        return at

    @property
    def total(self) -> int:
        return self.tokens[0]

    def _children(self, node: int) -> tuple[int, int]:
        return self.left.get(node, node + 1), self.right[node]

    def leaves(self, below: int = 0, path: tuple[int, ...] = ()) -> Iterator[tuple[int, tuple[int, ...]]]:
        """The leaves below a node with the nodes above each, in the order of the text."""
        stack = [(below, path)]
        while stack:
            node, path = stack.pop()
            if self.right[node]:
                left, right = self._children(node)
                stack += [(right, (*path, node)), (left, (*path, node))]
            else:
                yield node, path

    def _find(self, at: int) -> tuple[int, int, tuple[int, ...]]:
        """(leaf, where it starts, the nodes above it) of the character ``at``; the last leaf at the end of the text."""
        node, start, path = 0, 0, []
        while self.right[node]:
            path.append(node)
            left, right = self._children(node)
            if at < start + self.chars[left]:
                node = left
            else:
                node, start = right, start + self.chars[left]
        return node, start, (*path,)

    def _set(self, leaf: int, path: tuple[int, ...], text: str) -> None:
        change = len(text) - self.chars[leaf]
        for node in (*path, leaf):
            self.chars[node] += change
        self.touched += len(path) + 1
        self.dirty[leaf] = (text, path)

    def _count(self, leaf: int, path: tuple[int, ...], count: int) -> None:
        change = count - self.tokens[leaf]
        if change:
            for node in (*path, leaf):
                self.tokens[node] += change
            self.touched += len(path) + 1

    def edit(self, text: str, at: int, remove: int, insert: str) -> str:
        """The text after ``remove`` characters at ``at`` gave way to ``insert``; both are clipped to the text.

        Token counts are right again after ``settle``.
        """
        at = min(max(at, 0), len(text))
        end = min(at + max(remove, 0), len(text))
        after, change = text[:at] + insert + text[end:], at - end + len(insert)

        def safe(place: int) -> bool:
            return not place or bool(_SAFE.match(after, place - 1))

        first, start, path = self._find(at)
        stop, merged = start + self.chars[first], []
        # Leaves that lose characters, and neighbours over places that are no more safe to cut at, join the first one.
        while stop < len(text) and (stop < end or not safe(stop + change)):
            leaf, _, above = self._find(stop)
            stop += self.chars[leaf]
            merged.append((leaf, above))
        while start and not safe(start):
            merged.append((first, path))
            first, start, path = self._find(start - 1)
        for leaf, above in merged:
            self._set(leaf, above, "")
        pieces = cut(after[start : stop + change])
        self._set(first, path, "".join(pieces))
        if len(pieces) > 1:
            self._split(first, path, pieces)
        return after

    def _split(self, leaf: int, path: tuple[int, ...], pieces: list[str]) -> None:
        """Deal a leaf's text to several leaves below its node."""
        self._count(leaf, path, 0)
        del self.dirty[leaf]
        lengths, middle = [len(x) for x in pieces], (len(pieces) + 1) // 2
        self.left[leaf] = self._add(lengths, [0] * len(pieces), 0, middle)
        self.right[leaf] = self._add(lengths, [0] * len(pieces), middle, len(pieces))
        self.touched += 2 * len(pieces) - 2
        for piece, (part, above) in zip(pieces, self.leaves(leaf, path), strict=True):
            self.dirty[part] = (piece, above)
        if len(above) > 2 * len(self.chars).bit_length() + 8:
            self._balance()

    def _balance(self) -> None:
        """Build the tree anew from its leaves; empty ones go."""
        kept = [x for x, _ in self.leaves() if self.chars[x]]
        texts = [self.dirty.get(x) for x in kept]
        new = CountTree.of([self.chars[x] for x in kept], [self.tokens[x] for x in kept])
        self.chars, self.tokens, self.right, self.left = new.chars, new.tokens, new.right, {}
        self.touched += len(self.chars)
        self.dirty = {leaf: (found[0], path) for found, (leaf, path) in zip(texts, self.leaves(), strict=False) if found}

    def missing(self) -> list[str]:
        """The texts whose counts are missing."""
        return [x for x, _ in self.dirty.values()]

    def settle(self, counts: list[int]) -> None:
        """Enter the counts of the ``missing`` texts and update the sums above them."""
        for (leaf, (text, path)), count in zip(self.dirty.items(), counts, strict=True):
            self._count(leaf, path, count)
            self.encoded += len(text)
        self.dirty = {}

    def stored(self) -> CountTree:
        """The same tree with all nodes in preorder."""
        out = CountTree([], [], [])
        stack = [(0, -1)]
        while stack:
            node, parent = stack.pop()
            at = len(out.chars)
            if parent >= 0:
                out.right[parent] = at
            out.chars.append(self.chars[node])
            out.tokens.append(self.tokens[node])
            out.right.append(0)
            if self.right[node]:
                left, right = self._children(node)
                stack += [(right, at), (left, -1)]
        return out


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text_hash, chars, tokens, right) of each row's text (columns doc_id and text); null counts as empty, and an empty text is one leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder(tokenizer)
        for batch in batches:
            leaves = [cut(x or "") for x in batch.column(1).to_pylist()]
            counts = [len(x) // 4 for x in encoder.encode([x for row in leaves for x in row])]
            trees, at = [], 0
            for row in leaves:
                trees.append(CountTree.of(list(map(len, row)), counts[at : at + len(row)]))
                at += len(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *_columns(trees)], names=["doc_id", "text_hash", "chars", "tokens", "right"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, chars array<int>, tokens array<int>, right array<int>")


def _columns(trees: list[CountTree]) -> list[pa.Array]:
    return [pa.array([getattr(x, name) for x in trees], pa.list_(pa.int32())) for name in ("chars", "tokens", "right")]


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str, with_text: bool = False) -> DataFrame:
    """(doc_id, n_edits, n_tokens, n_tokens_after, chars_encoded[, text, chars, tokens, right]) of each row of ``docs``.

    ``edits`` has (doc_id, seq, at, remove, insert): at character ``at`` of the
    text as the edits before it left it, ``remove`` characters are replaced by
    ``insert``; places outside the text are clipped, nulls are 0 and empty.
    Documents without edits keep their counts, and their texts are not read
    unless asked for. Rows that repeat a doc_id get the same edits each; edits of
    a doc_id that is null or not there have no effect. All edits of a document
    are applied in one task, after another as they must.
    """
    scripts = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "remove", "insert"))).alias("edits"))
    known = trees.dropDuplicates(["doc_id", "text_hash"]) if with_text else trees
    edited = known.join(scripts, known.doc_id == scripts.of, "left" if with_text else "inner")
    edited = edited.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash_of"), "chars", "tokens", "right", "edits")
    if not with_text:
        edited = edited.dropDuplicates(["of", "hash_of"])
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # Only the id is a key of the join, so that trees and edits, dealt by it already, are not dealt anew.
    same_id = F.col("doc_id").eqNullSafe(F.col("of")) if with_text else F.col("doc_id") == F.col("of")
    both = source.join(edited.hint("shuffle_hash"), same_id & (F.col("text_hash").bitwiseXOR(F.col("hash_of")) == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder(tokenizer)
        for batch in batches:
            rows, found = [], []
            for doc, text, chars, tokens, right, script in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree, text = CountTree(chars, tokens, right), text or ""
                before = tree.total
                for e in script or ():
                    text = tree.edit(text, e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                rows.append((doc, len(script or ()), before, text))
                found.append(tree)
            counts = iter([len(x) // 4 for x in encoder.encode([x for tree in found for x in tree.missing()])])
            for tree in found:
                tree.settle([next(counts) for _ in tree.dirty])
            docs, edits, before, texts = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [pa.array(docs, pa.int64()), pa.array(edits, pa.int32()), pa.array(before, pa.int64()), pa.array([x.total for x in found], pa.int64()), pa.array([x.encoded for x in found], pa.int64())]
            if with_text:
                arrays += [pa.array(texts, pa.string()), *_columns([x.stored() for x in found])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_edits", "n_tokens", "n_tokens_after", "chars_encoded", *["text", "chars", "tokens", "right"] * with_text])

    schema = "doc_id long, n_edits int, n_tokens long, n_tokens_after long, chars_encoded long"
    out = both.select("doc_id", "text", "chars", "tokens", "right", "edits").mapInArrow(run, schema + ", text string, chars array<int>, tokens array<int>, right array<int>" * with_text)
    if with_text:
        return out
    total = F.get("tokens", F.lit(0)).cast("long")
    rest = trees.join(scripts, trees.doc_id == scripts.of, "left_anti")
    return out.unionByName(rest.select("doc_id", F.lit(0).alias("n_edits"), total.alias("n_tokens"), total.alias("n_tokens_after"), F.lit(0).cast("long").alias("chars_encoded")))


def count_edited(docs: DataFrame, edits: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``build``, then ``apply_edits``; the trees are written to the shared folder in between."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    trees = Workspace(docs.sparkSession).keep(build(source, tokenizer), "trees")
    return apply_edits(source, trees, edits, tokenizer)
