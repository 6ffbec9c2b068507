"""Edit-aware token counts.

Byte-pair encoding works within pre-tokens, so a text's count is the sum over its pre-tokens. For every document a segment
tree is kept whose leaves are runs of pre-tokens with their characters and tokens. An edit re-splits only the leaves it
touches, with a few pre-tokens of context before and as much after as it takes until an old boundary comes up again; their
new sums go up the tree. Everything else keeps its counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed: how the vocabulary splits a text before it is encoded. Each match depends on what follows its start only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEAF = 32  # pre-tokens in a leaf when a tree is built; at four times as many the tree is built anew
CONTEXT = 4  # pre-tokens before an edit that are split again
CACHE = 500_000  # pre-tokens whose count a worker remembers


class Counter:
    """Counts tokens of pre-tokens, remembering frequent ones."""

    def __init__(self, vocabulary: list[str]):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary)}
        self.split = regex.compile(PATTERN).findall
        self.encode = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> int:
        known, total = self.known, 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.encode(p))
                if len(known) >= CACHE:
                    known.clear()
                known[p] = n
            total += n
        return total


class Tree:
    """Sums of characters, pre-tokens and tokens over leaves of text."""

    def __init__(self, texts: list[str], pieces: list[int], tokens: list[int]):
        self.texts = texts
        self.size = 1
        while self.size < max(1, len(texts)):
            self.size *= 2
        self.sums = [[0, 0, 0] for _ in range(2 * self.size)]
        for i, row in enumerate(zip(map(len, texts), pieces, tokens)):
            self.sums[self.size + i] = list(row)
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = [a + b for a, b in zip(self.sums[2 * i], self.sums[2 * i + 1])]

    @classmethod
    def build(cls, text: str, counter: Counter) -> Tree:
        pieces = counter.split(text)
        runs = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        return cls(["".join(r) for r in runs], [len(r) for r in runs], [counter.count(r) for r in runs])

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][2]

    def leaf(self, i: int) -> list[int]:
        return self.sums[self.size + i]

    def put(self, i: int, text: str, pieces: int, tokens: int) -> None:
        self.texts[i] = text
        at = self.size + i
        self.sums[at] = [len(text), pieces, tokens]
        while at > 1:
            at //= 2
            self.sums[at] = [a + b for a, b in zip(self.sums[2 * at], self.sums[2 * at + 1])]

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds this character, and where the leaf starts; the last leaf for the text's end."""
        at, start = 1, 0
        while at < self.size:
            at *= 2
            if char >= start + self.sums[at][0] and self.sums[at + 1][0]:
                start += self.sums[at][0]
                at += 1
        return at - self.size, start

    def edit(self, start: int, stop: int, text: str, counter: Counter) -> int:
        """Put ``text`` in the place of the characters start to stop; returns how many characters were split again."""
        if not self.texts:
            fresh = Tree.build(text, counter)
            self.texts, self.size, self.sums = fresh.texts, fresh.size, fresh.sums
            return len(text)
        start = max(0, min(start, self.chars))
        stop = max(start, min(stop, self.chars))
        first, offset = self.find(start)
        last, _ = self.find(max(start, stop - 1))
        # the pre-token at the edit, and as many before it as its split could hang on
        before = 0
        while first > 0 and before < CONTEXT:
            first -= 1
            offset -= len(self.texts[first])
            before += self.leaf(first)[1]
        region = "".join(self.texts[first : last + 1])
        region = region[: start - offset] + text + region[stop - offset :]
        while True:
            # text after the region up to a letter or sign, on which a run of blanks at its end hangs
            ahead, nxt = "", last + 1
            while nxt < len(self.texts) and not ahead.strip():
                ahead += self.texts[nxt]
                nxt += 1
            pieces, at = [], 0
            for p in counter.split(region + ahead):
                if at >= len(region):
                    break
                pieces.append(p)
                at += len(p)
            if at == len(region):
                break
            last += 1  # a pre-token reaches over the old boundary
            region += self.texts[last]
        if len(pieces) > 4 * LEAF:
            runs = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
            new = [("".join(r), len(r), counter.count(r)) for r in runs]
            old = [(t, *self.leaf(i)[1:]) for i, t in enumerate(self.texts)]
            self.__init__(*map(list, zip(*old[:first], *new, *old[last + 1 :])))
        else:
            for i in range(first + 1, last + 1):
                self.put(i, "", 0, 0)
            self.put(first, region, len(pieces), counter.count(pieces))
        return len(region)


def _leaves(tree: Tree) -> tuple[list[int], list[int], list[int]]:
    rows = [tree.leaf(i) for i in range(len(tree.texts)) if tree.texts[i]]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


_READY: dict[str, Counter] = {}


def _counter(vocabulary) -> Counter:
    name = str(vocabulary.id)
    if name not in _READY:
        _READY.clear()
        _READY[name] = Counter(vocabulary.value)
    return _READY[name]


class _Vocabulary:
    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id(), broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"id": self.id, "broadcast": self.broadcast}


TREE = "n_tokens long, leaf_chars array<int>, leaf_pieces array<int>, leaf_tokens array<int>"


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    cols = {n: a for n, a in zip(batch.schema.names, batch.columns)} | new
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _tree_columns(trees: list[Tree]) -> dict[str, pa.Array]:
    leaves = [_leaves(t) for t in trees]
    out = {"n_tokens": pa.array([t.tokens for t in trees], pa.int64())}
    return out | {n: pa.array([x[i] for x in leaves], pa.list_(pa.int32())) for i, n in enumerate(("leaf_chars", "leaf_pieces", "leaf_tokens"))}


def _build(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    counter = _counter(vocabulary)
    for batch in batches:
        trees = [Tree.build(x.as_py() or "", counter) for x in batch.column("text")]
        yield _with(batch, _tree_columns(trees))


def _edit(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    counter = _counter(vocabulary)
    for batch in batches:
        trees, again, texts = [], [], []
        for text, chars, pieces, tokens, edits in zip(*(batch.column(c) for c in ("text", "leaf_chars", "leaf_pieces", "leaf_tokens", "edits"))):
            text, at, parts = text.as_py() or "", 0, []
            for n in chars.as_py():
                parts.append(text[at : at + n])
                at += n
            tree = Tree(parts, pieces.as_py(), tokens.as_py())
            spent = 0
            for e in edits.as_py() or ():
                if e is not None:
                    spent += tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "", counter)
            trees.append(tree)
            again.append(spent)
            texts.append("".join(tree.texts))
        new = _tree_columns(trees) | {"text": pa.array(texts, pa.string()), "encoded_chars": pa.array(again, pa.int64())}
        yield _with(batch, new)


def _fields(df: DataFrame, without=()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def _shared(df: DataFrame, vocabulary: str) -> _Vocabulary:
    """The vocabulary file, read by Spark from wherever it is: some 50,000 lines."""
    lines = [r.value for r in df.sparkSession.read.text(vocabulary).collect() if r.value.strip()]
    return _Vocabulary(df.sparkSession.sparkContext.broadcast(lines))


def build(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``docs`` with n_tokens and its tree: leaf_chars, leaf_pieces (pre-tokens) and leaf_tokens, leaf by leaf.

    Needs a column text; a null text counts as empty and has no leaves. Columns of those names are replaced, others stay.
    """
    docs = docs.drop("n_tokens", "leaf_chars", "leaf_pieces", "leaf_tokens")
    shared = _shared(docs, vocabulary)
    return docs.mapInArrow(lambda batches: _build(batches, shared), f"{_fields(docs)}, {TREE}")


def edit(trees: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``trees`` (from ``build``, or from here) with text, n_tokens and leaves as they are after ``edits``.

    ``edits`` is an array of (start, stop, text), applied in its order: ``text`` replaces the characters from start to
    before stop of the text as it then is. Places beyond the end mean the end, null numbers 0, a null text nothing; a null
    array and null entries change nothing. ``encoded_chars`` is how much was split and encoded again.
    """
    shared = _shared(trees, vocabulary)
    trees = trees.drop("encoded_chars")
    return trees.mapInArrow(lambda batches: _edit(batches, shared), f"{_fields(trees)}, encoded_chars long")


def gather_edits(edits: DataFrame) -> DataFrame:
    """(doc_id, edits) for ``edit``, from one row per edit: doc_id, seq, start, stop, text, in the order of seq."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "text")))
    strip = F.transform(rows, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text")))
    return edits.groupBy("doc_id").agg(strip.alias("edits"))
