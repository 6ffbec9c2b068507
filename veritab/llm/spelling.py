"""Spelling variants: words one edit apart, found with k-d trees over letter-count vectors.

One inserted or deleted letter changes one count by one, a replaced letter takes one from a count and adds one to another:
at most two in L1. Words of each length get a k-d tree over their letter counts. A word searches the trees of its own length
and of the lengths next to it; a branch is followed only if its box can be reached with the letters that one edit may add
and take away. What a leaf holds is compared by counts, and what passes letter by letter.

The upper part of each tree, fitted to a bounded sample, deals words and searches to tasks; the tree goes on inside each
task. The sample decides only how even the parts are. A search brings back how many words it found and the best of them, so
no pair is ever a row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])  # in Latin-1
# Latin-1 bytes: A to Z lower-cased, other letters as they are, everything else a blank
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in LETTERS else 32 for c in range(256))
# the letters that words consist of, as dimensions
SYMBOLS = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
DIMENSION = np.zeros(256, np.int64)
DIMENSION[SYMBOLS] = np.arange(len(SYMBOLS))

DROPPED = 199  # of so many runs in a document, by a hash, one loses a letter
SHORTEST, RAREST = 6, 5  # code points and occurrences of a word
TIMES = 5  # a form occurs at least so many times as often
HELD = 400_000  # words held by a task before they are passed on
PART_WORDS = 20_000  # of one length that a task searches, about
SAMPLE = 100_000  # words to which the upper trees are fitted
LEAF = 24
PIECE = 4_000_000  # characters of text split at once


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters of a text, some at a time; a run is never cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and ord(text[end]) < 256 and FOLD[ord(text[end])] != 32:
            end += 1
        yield text[at:end].encode("latin-1", "replace").translate(FOLD).split()
        at = end


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def _count(batches: Iterator[pa.RecordBatch], dropped: int, shortest: int, held_most: int) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def passed_on():
        words, n = [w.decode("latin-1") for w in held], list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            counted: Counter = Counter()
            for part in runs(text):
                counted.update(part)
            begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for w, n in counted.items():
                if len(w) < shortest:
                    continue
                h = zlib.crc32(_utf8(w), begin)
                if h % dropped == 0:
                    i = h % len(w)
                    w = w[:i] + w[i + 1 :]
                    if len(w) < shortest:
                        continue
                held[w] = held.get(w, 0) + n
            if len(held) >= held_most:
                yield passed_on()
    if held:
        yield passed_on()


def vocabulary(docs: DataFrame, dropped: int = DROPPED, shortest: int = SHORTEST, rarest: int = RAREST, held: int = HELD) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` letters with at least ``rarest`` occurrences."""
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL")
    counted = rows.mapInArrow(lambda b: _count(b, dropped, shortest, held), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts of words as rows of letters."""
    n, length = letters.shape
    at = (np.arange(n)[:, None] * len(SYMBOLS) + DIMENSION[letters]).ravel()
    out = np.bincount(at, minlength=n * len(SYMBOLS)).reshape(n, len(SYMBOLS))
    return out.astype(np.int8 if length < 120 else np.int32)


@dataclass
class Tree:
    """A k-d tree over letter counts. ``split[i]`` is the dimension and ``most[i]`` the largest count of the left branch of
    node i, ``left`` and ``right`` its branches; a leaf has split -1 and its number in ``left``."""

    split: list[int] = field(default_factory=list)
    most: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, counts: np.ndarray, leaf: int) -> "Tree":
        """Branches are parted where that is most even, until they have ``leaf`` rows or all their rows are equal."""
        tree = cls()
        todo = [(np.arange(len(counts)), None, False)]
        while todo:
            rows, above, right = todo.pop()
            node = len(tree.split)
            if above is not None:
                (tree.right if right else tree.left)[above] = node
            d, cut = (-1, 0) if len(rows) <= leaf else cls._halves(counts[rows])
            tree.split.append(d)
            tree.most.append(cut)
            tree.left.append(len(tree.leaves) if d < 0 else -1)
            tree.right.append(-1)
            if d < 0:
                tree.leaves.append(rows)
            else:
                low = counts[rows, d] <= cut
                todo += [(rows[~low], node, True), (rows[low], node, False)]
        return tree

    @staticmethod
    def _halves(counts: np.ndarray) -> tuple[int, int]:
        """The dimension and count that part the rows most evenly; -1 if all are equal."""
        part = counts if len(counts) <= 4096 else counts[:: len(counts) // 4096]
        best = (0.0, -1, 0)
        for cut in range(3):
            share = (part > cut).mean(axis=0)
            even = np.minimum(share, 1 - share)
            d = int(np.argmax(even))
            best = max(best, (float(even[d]), -d, cut), key=lambda x: x[0]) if even[d] > 0 else best
        if best[0] > 0:
            return -best[1], best[2]
        apart = np.flatnonzero(counts.max(axis=0) > counts.min(axis=0))
        if len(apart) == 0:
            return -1, 0
        seen = np.unique(counts[:, apart[0]])
        return int(apart[0]), int(seen[(len(seen) - 1) // 2])

    def search(self, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the rows of ``counts`` that can reach its box by adding ``more`` letters and taking ``less`` away.

        A box is known by the splits on the way to it; per dimension the tightest ones count.
        """
        n = len(counts)
        start = (0, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {}, {})
        todo = [start]
        while todo:
            node, rows, add, take, low, high = todo.pop()
            d = self.split[node]
            if d < 0:
                yield self.left[node], rows
                continue
            x, cut = counts[rows, d].astype(np.int32), self.most[node]
            # left: at most cut of this letter; what the box asked for before is part of it
            take_left = take + np.maximum(0, x - cut) - (np.maximum(0, x - high[d]) if d in high else 0)
            add_right = add + np.maximum(0, cut + 1 - x) - (np.maximum(0, low[d] - x) if d in low else 0)
            go = take_left <= less
            if go.any():
                todo.append((self.left[node], rows[go], add[go], take_left[go], low, {**high, d: cut}))
            go = add_right <= more
            if go.any():
                todo.append((self.right[node], rows[go], add_right[go], take[go], {**low, d: cut + 1}, high))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one edit: equal lengths by one letter, else one has a letter more."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = np.cumprod(a == b[:, :n], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int32)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int32)
    return ahead + behind >= n


FOUND = "word string, near long, best_n long, best string"


def _search(asked: pa.Table, rows: pa.Table, leaf: int) -> pa.Table:
    """For the words asked about: how many of ``rows``, words of one length, are one edit away, and the best of them."""
    out = ([], [], [], [])
    if asked.num_rows and rows.num_rows:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        # the best first: most occurrences, then code point order, so that the smallest number among the found is the best
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        words, n = [words[i] for i in order], n[np.array(order)]
        letters = letters_of(words)
        counts = counts_of(letters)
        tree = Tree.build(counts, leaf)
        length = letters.shape[1]
        by_length: dict[int, list[str]] = {}
        for w in asked.column("word").to_pylist():
            by_length.setdefault(len(w), []).append(w)
        for own, mine in by_length.items():
            for lo in range(0, len(mine), 4096):
                some = mine[lo : lo + 4096]
                l2 = letters_of(some)
                c2 = counts_of(l2)
                near, best = np.zeros(len(some), np.int64), np.full(len(some), len(words))
                more, less = int(length >= own), int(length <= own)
                for at, reach in tree.search(c2, more, less):
                    held = tree.leaves[at]
                    for k in range(0, len(reach), max(1, 2_000_000 // (len(held) * len(SYMBOLS)))):
                        q = reach[k : k + max(1, 2_000_000 // (len(held) * len(SYMBOLS)))]
                        apart = np.abs(c2[q][:, None, :].astype(counts.dtype) - counts[held][None, :, :]).sum(axis=2, dtype=np.int32)
                        i, j = np.nonzero(apart == more + less)
                        if len(i) == 0:
                            continue
                        ok = one_edit(l2[q[i]], letters[held[j]])
                        i, j = q[i[ok]], held[j[ok]]
                        np.add.at(near, i, 1)
                        np.minimum.at(best, i, j)
                for i in np.flatnonzero(near):
                    for column, value in zip(out, (some[i], int(near[i]), int(n[best[i]]), words[best[i]])):
                        column.append(value)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["word", "near", "best_n", "best"])


def upper_trees(words: DataFrame, part_words: int, sample: int) -> dict[int, Tree]:
    """A tree for each length with leaves of about ``part_words`` words, fitted to some words with the smallest hashes.

    Lengths with few words need no tree. ``sample`` words at most reach the driver, split among the lengths that need one.
    """
    sizes = {r.length: r.m for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > part_words).collect()}
    trees = {}
    for length, m in sizes.items():
        some = words.filter(F.char_length("word") == length).orderBy(F.xxhash64("word")).limit(max(1, sample // len(sizes))).select("word").collect()
        trees[length] = Tree.build(counts_of(letters_of([r.word for r in some])), max(1, part_words * len(some) // m))
    return trees


def _deal(batches: Iterator[pa.RecordBatch], trees: dict[int, Tree], searches: bool) -> Iterator[pa.RecordBatch]:
    """Words with the length and part of the tree that holds them, or, for searches, all that can hold their neighbours."""
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        took, lengths, parts = [], [], []
        for own, rows in by_length.items():
            rows = np.array(rows)
            counts = None
            for length in (own - 1, own, own + 1) if searches else (own,):
                if length not in trees:
                    took.append(rows)
                    parts.append(np.zeros(len(rows), np.int64))
                    lengths.append(np.full(len(rows), length))
                    continue
                if counts is None:
                    counts = counts_of(letters_of([words[i] for i in rows]))
                more, less = (int(length >= own), int(length <= own)) if searches else (0, 0)
                for at, reach in trees[length].search(counts, more, less):
                    took.append(rows[reach])
                    parts.append(np.full(len(reach), at))
                    lengths.append(np.full(len(reach), length))
        if took:
            took, lengths, parts = (np.concatenate(c) for c in (took, lengths, parts))
            columns = [pa.array([words[i] for i in took], pa.string()), pa.array(n[took], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int32()), pa.array(parts, pa.int32())], ["word", "n", "length", "part"])


def neighbours(words: DataFrame, part_words: int = PART_WORDS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(word, n_near, form_n, form) of the words, distinct with their n, that have words one edit away; form is the one with most n."""
    trees = upper_trees(words, part_words, sample)
    dealt = "word string, n long, length int, part int"
    rows = words.mapInArrow(lambda b: _deal(b, trees, False), dealt)
    asked = words.mapInArrow(lambda b: _deal(b, trees, True), dealt)
    found = asked.groupBy("length", "part").cogroup(rows.groupBy("length", "part")).applyInArrow(lambda a, b: _search(a, b, leaf), FOUND)
    # most n first, then the smallest in code point order, which is that of UTF-8
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.best").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Each round doubles the steps taken.

    A form occurs several times as often as its word, so chains are short and never close.
    """
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("w"), F.col("root").alias("further"))
        at = at.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("w").isNotNull().alias("moved"))
        at = materialise(at, "roots")
        if at.filter("moved").isEmpty():
            return at.drop("moved")


def group_variants(docs: DataFrame, dropped: int = DROPPED, shortest: int = SHORTEST, rarest: int = RAREST, times: int = TIMES, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts, and the more frequent spelling each may stand for.

    ``docs`` has doc_id and text; further columns are dropped. Words are runs of A to Z, a to z and U+00C0 to U+00FF, A to Z
    lower-cased. A run whose crc32 with its document's id (a null id is empty) is a multiple of ``dropped`` loses one
    letter, in every place it has in the document. Null and empty texts have no words; repeated rows count repeatedly.
    ``n_near`` counts the words one edit away; the one with most occurrences (ties: first in code point order) is the form
    if it has ``times`` as many as the word, else form and form_n are null and the word is its own root.
    """
    words = materialise(vocabulary(docs, dropped, shortest, rarest), "words")
    near = materialise(neighbours(words, **how), "near")
    at = words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").drop("w")
    enough = F.col("form_n") >= F.col("n") * times
    at = at.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(enough, F.col(c)).alias(c) for c in ("form", "form_n")])
    at = materialise(at, "forms")
    last = roots(at.filter("form IS NOT NULL")).select(F.col("word").alias("w"), "root")
    out = at.join(last, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
