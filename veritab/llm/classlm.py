"""Language-model scores from a Brown class-based bigram model.

P(text) is the product over its tokens of P(class | class before) * P(token | class). Exchange clustering assigns types to
classes so that the class bigrams of the training texts become as likely as possible. Types are the words, each by itself
from two occurrences and one in a million tokens on (a million words at most, which bounds what the executors hold), and
groups of rarer words by how they end; a rarer word is emitted by its group. All counts cover all training texts.

Clustering has two steps. The words with one in 10,000 tokens (10,000 at most) and the groups are exchanged one after the
other over their bigrams. Every other type starts in the class of its group; its neighbours' classes are counted on Spark,
and shares of the types then move side by side, each to the class where the likelihood gains most, against broadcast class
totals. A share's moves are kept only if the likelihood of all of them together gained; if not, shares get smaller. Both
steps go on until a sweep gains next to nothing. Neighbours' classes are those of the first step throughout the second; the
class bigrams that score texts are counted anew at the end.

Words from one in a million tokens on go to the executors with their counts and classes (some 20 MB at most); counts of the
others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise
from .neardup import CHUNK, U64, cut, hash_words, mix64

GROUPS = 256  # of rarer words, by a hash of their last two bytes
CLASSES = 48
FREQUENT = 1e-4  # share of the training tokens from which words are exchanged one after the other
OWN = 1e-6  # share from which a word is a type of its own and its count and class go to the executors
LEAST = 2  # occurrences that a type of its own needs in any case
SETTLED = 0.01  # a sweep that adds less than this share of the gain so far is the last one
THIN = 0.05  # of an average class's tokens, added to every class while moves are weighed
MOST_SHARES = 64  # of the types that move side by side
ADD = 0.1  # added to counts, fixed for the base score
PRIOR = 10.0  # weight of the class unigram in a class bigram
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end token among word hashes


def tokenise(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Word hashes, groups and text numbers of whole texts, an end token after each; some CHUNK bytes at a time.

    Also yields the range of texts covered.
    """
    lo = 0
    while lo < len(texts):
        pieces, owner, hi, size = [], [], lo, 0
        while hi < len(texts) and (hi == lo or size < CHUNK):
            for piece in cut((texts[hi] or "").encode("utf-8", "surrogatepass")):
                pieces.append(piece)
                owner.append(hi - lo)
                size += len(piece)
            hi += 1
        hashes, groups, docs = [], [], []
        at = 0
        while at < len(pieces):
            upto, size = at, 0
            while upto < len(pieces) and (upto == at or size + len(pieces[upto]) <= CHUNK):
                size += len(pieces[upto])
                upto += 1
            data = b"\n".join(pieces[at:upto])
            h, start, end = hash_words(data)
            begins = np.cumsum([0] + [len(p) + 1 for p in pieces[at : upto - 1]])
            b = np.frombuffer(data, np.uint8)
            tail = b[end - 1].astype(U64) * U64(257) + np.where(end - start > 1, b[end - 2], 0).astype(U64)
            hashes.append(h)
            groups.append((mix64(tail) % U64(GROUPS)).astype(np.int32))
            docs.append(np.array(owner[at:upto], np.int64)[np.searchsorted(begins, start, side="right") - 1])
            at = upto
        n = hi - lo
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        g = np.concatenate(groups) if groups else np.zeros(0, np.int32)
        d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        # the end tokens between them
        at = np.arange(len(d)) + d
        last = np.cumsum(np.bincount(d, minlength=n)) + np.arange(n)
        h2, g2, d2 = np.full(len(d) + n, END), np.full(len(d) + n, -1, np.int32), np.empty(len(d) + n, np.int64)
        h2[at], g2[at], d2[at] = h, g, d
        d2[last] = np.arange(n)
        yield h2, g2, d2, lo, hi
        lo = hi


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, g, _, _, _ in tokenise(batch.column("text").to_pylist()):
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(g[first], pa.int32()), pa.array(n, pa.int64())], names=["word", "group", "n"])


class Types:
    """The types as numbers: frequent words by their sorted hashes, the end token among them, then the groups."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.many = len(words) + GROUPS

    def of(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words) + g)


def _pairs(batches: Iterator[pa.RecordBatch], types: Types) -> Iterator[pa.RecordBatch]:
    start = types.many  # the state before the first token
    for batch in batches:
        for h, g, d, _, _ in tokenise(batch.column("text").to_pylist()):
            t = types.of(h, g)
            before = np.concatenate([[start], np.where(d[1:] == d[:-1], t[:-1], start)])
            u, n = np.unique(before * (types.many + 1) + t, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u // (types.many + 1), pa.int32()), pa.array(u % (types.many + 1), pa.int32()), pa.array(n, pa.int64())],
                names=["a", "b", "n"],
            )


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(total: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for what no exchange changes."""
    return float(_xlogx(total).sum() - _xlogx(total.sum(axis=0)).sum() - _xlogx(total.sum(axis=1)).sum())


def exchange(pairs: DataFrame, many: int, start: int, end: int, freq: np.ndarray, classes: int) -> np.ndarray:
    """The class of each type. Class 0 is the end token's alone, the last number the start's.

    Each round counts, for each type and class, the class's tokens that follow and precede the type; then types of one half
    move, one after the other, to the class where the likelihood gains most (the smallest number of ties, staying before
    moving), the class counts being kept up to date. The halves alternate, as types that follow each other would else move
    past one another. It ends when two rounds added next to nothing to the likelihood, with the best classes of all rounds.
    """
    spark = pairs.sparkSession
    order = np.argsort(-freq, kind="stable")
    of = np.empty(many + 1, np.int64)
    of[order] = 1 + np.arange(many) % (classes - 1)
    of[end], of[start] = 0, classes
    seen, best = [], of
    while True:
        after, ahead = _by_class(spark, pairs, of, many, classes)
        total = np.zeros((classes + 1, classes + 1))
        np.add.at(total, of, after)
        seen.append(likelihood(total))
        if seen[-1] >= max(seen):
            best = of.copy()
        r = len(seen) - 1
        if r >= 2 and max(seen) - max(seen[:-2]) <= SETTLED * (max(seen) - seen[0]):
            return best
        for w in np.flatnonzero((np.arange(many) + r) % 2 == 0):
            if w == end or freq[w] == 0:
                continue
            a, right, left = of[w], after[w], ahead[w]
            total[a] -= right
            total[:, a] -= left
            np.maximum(total, 0, out=total)
            rows, cols = total.sum(axis=1), total.sum(axis=0)
            gain = (_xlogx(total + right) - _xlogx(total)).sum(axis=1) + (_xlogx(total + left[:, None]) - _xlogx(total)).sum(axis=0)
            gain -= _xlogx(rows + right.sum()) - _xlogx(rows) + _xlogx(cols + left.sum()) - _xlogx(cols)
            b = 1 + int(np.argmax(gain[1:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            total[b] += right
            total[:, b] += left
            of[w] = b


def _by_class(spark, pairs: DataFrame, of: np.ndarray, many: int, classes: int):
    """after[w, c] and ahead[w, c]: tokens of class c after and before type w."""
    known = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(of)], "t int, c int"))
    out = []
    for mine, theirs in (("a", "b"), ("b", "a")):
        got = pairs.join(known, F.col(theirs) == F.col("t")).groupBy(mine, "c").agg(F.sum("n").alias("n")).toArrow()
        m = np.zeros((many + 1, classes + 1))
        m[got.column(mine).to_numpy(), got.column("c").to_numpy()] = got.column("n").to_numpy()
        out.append(m)
    return out


def _contexts(batches: Iterator[pa.RecordBatch], types: Types, of: np.ndarray, moving: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each moving type has each class before it (k) and after it (k beyond the start's number)."""
    start = int(of[-1])
    for batch in batches:
        for h, g, d, _, _ in tokenise(batch.column("text").to_pylist()):
            t = types.of(h, g)
            c = of[t]
            at = np.flatnonzero(moving[t])  # never an end token, so one follows in the same text
            first = (at == 0) | (d[at] != d[np.maximum(at, 1) - 1])
            before = np.where(first, start, c[np.maximum(at, 1) - 1])
            wide = 2 * (start + 1)
            u, n = np.unique(np.concatenate([t[at] * wide + before, t[at] * wide + start + 1 + c[at + 1]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u // wide, pa.int32()), pa.array(u % wide, pa.int32()), pa.array(n, pa.int64())], names=["t", "k", "n"])


def _twice(total: np.ndarray, w: np.ndarray, a: np.ndarray, k: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """What cells add that a move from class a changes twice: between a and the new class, and of either with itself."""
    every = np.zeros((len(w), 2 * len(total)))
    every[owner, k] = n
    left, right = every[:, : len(total)], every[:, len(total) :]
    line = np.arange(len(w))
    la, ra = left[line, a], right[line, a]

    def both(cell, x, y):
        return _xlogx(cell + x + y) - _xlogx(cell + x) - _xlogx(cell + y) + _xlogx(cell)

    out = both(total[a], la[:, None], -right) + both(total[:, a].T, ra[:, None], -left) + both(np.diag(total), left, right)
    out += both(total[a, a], -la, -ra)[:, None]
    out[line, a] = 0
    return out


def _moves(batches: Iterator[pa.RecordBatch], of: np.ndarray, total: np.ndarray, share: int, shares: int) -> Iterator[pa.RecordBatch]:
    """The types of one share that gain by another class, that class, and what their moves add to the class bigrams.

    A type's gain in each class is exact as long as no other type moves.
    """
    start = len(total) - 1
    known = np.concatenate([total, total.T])  # by k: how often each class stands beside
    delta = np.zeros_like(total)
    moved, into = [], []
    for batch in batches:
        near = batch.column("near")
        t, offsets = batch.column("t").to_numpy(), near.offsets.to_numpy()
        values = near.values
        ks, ns = values.field("k").to_numpy(), values.field("n").to_numpy().astype(float)
        at = 0
        while at < len(t):  # some 20,000 counts at a time; a type has 2 * (start + 1) at most
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 20_000, side="right")) - 1)
            lo, hi = offsets[at], offsets[upto]
            size = np.diff(offsets[at : upto + 1])
            pick = t[at:upto] % shares == share
            kept = np.repeat(pick, size)
            w, size = t[at:upto][pick], size[pick]
            k, n = ks[lo:hi][kept], ns[lo:hi][kept]
            at = upto
            if not len(w):
                continue
            a = of[w]
            owner = np.repeat(np.arange(len(w)), size)
            begins = np.cumsum(size) - size
            x = known[k]
            each = _xlogx(x + n[:, None]) - _xlogx(x)
            own, line = x[np.arange(len(k)), a[owner]], np.arange(len(k))
            each[line, a[owner]] = _xlogx(own) - _xlogx(np.maximum(own - n, 0))
            gain = np.add.reduceat(each, begins, axis=0)
            gain += _twice(total, w, a, k, n, owner)
            many = np.add.reduceat(np.where(k > start, n, 0.0), begins)
            for margin in (total.sum(axis=1), total.sum(axis=0)):
                less = _xlogx(margin + many[:, None]) - _xlogx(margin)
                less[np.arange(len(w)), a] = _xlogx(margin[a]) - _xlogx(np.maximum(margin[a] - many, 0))
                gain -= less
            b = 1 + np.argmax(gain[:, 1:start], axis=1)
            b = np.where(gain[np.arange(len(w)), b] > gain[np.arange(len(w)), a] + 1e-9, b, a)
            go = b != a
            moved.append(w[go])
            into.append(b[go])
            ahead = k <= start
            for side, sign in ((a, -1.0), (b, 1.0)):
                of_word = side[owner]
                np.add.at(delta, (np.where(ahead, k, of_word), np.where(ahead, of_word, k - start - 1)), sign * np.where(go[owner], n, 0.0))
    if moved:
        out = [np.concatenate(moved).astype(np.int32), np.concatenate(into).astype(np.int16), delta]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], names=["moved", "into", "delta"])


def _thickened(total: np.ndarray) -> np.ndarray:
    """Class bigrams with a few average neighbours for every class words may move to.

    An empty class would draw every type by itself, and all of them at once make it worse.
    """
    rows, cols, tokens = total.sum(axis=1), total.sum(axis=0), max(total.sum(), 1.0)
    open_ = np.zeros(len(total))
    open_[1:-1] = THIN / (len(total) - 1)
    return total + np.outer(open_, cols) + np.outer(rows, open_)


def refine(contexts: DataFrame, of: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and class bigrams after the moves of all types of ``contexts``, share by share; the likelihood never falls."""
    sc = contexts.sparkSession.sparkContext
    of, total, like, gained, shares = of.copy(), total.copy(), likelihood(total), 0.0, 2
    while True:
        before, refused = like, False
        for share in range(shares):
            sent = sc.broadcast((of, _thickened(total)))
            found = contexts.mapInArrow(lambda rows, s=share, m=shares, v=sent: _moves(rows, *v.value, s, m), "moved binary, into binary, delta binary").collect()
            new = total + sum((np.frombuffer(r["delta"]).reshape(total.shape) for r in found), np.zeros_like(total))
            if likelihood(new) > like:
                total, like = new, likelihood(new)
                for r in found:
                    of[np.frombuffer(r["moved"], np.int32)] = np.frombuffer(r["into"], np.int16)
            else:
                refused |= any(len(r["moved"]) for r in found)
            sent.unpersist()
        gained += like - before
        if like - before <= SETTLED * gained and (not refused or shares >= MOST_SHARES):
            return of, total
        shares *= 2 if refused else 1


def _steps(batches: Iterator[pa.RecordBatch], types: Types, of: np.ndarray) -> Iterator[pa.RecordBatch]:
    start = int(of[-1])
    seen = np.zeros((start + 1) ** 2, np.int64)
    for batch in batches:
        for h, g, d, _, _ in tokenise(batch.column("text").to_pylist()):
            c = of[types.of(h, g)]
            before = np.concatenate([[start], np.where(d[1:] == d[:-1], c[:-1], start)])
            seen += np.bincount(before * (start + 1) + c, minlength=len(seen))
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32()), pa.array(seen[seen > 0])], names=["k", "n"])


class Model:
    """What scoring needs: classes, class bigrams, counts of types, and counts of the words that are types of their own."""

    def __init__(self, types: Types, of, bigrams, type_counts, group_words, sent, counts, tokens, distinct, classes):
        self.types, self.tokens, self.distinct = types, tokens, distinct
        self.sent, self.counts = sent, counts  # sorted hashes and their counts
        self.of = of
        into = bigrams.sum(axis=0)[:classes] + ADD
        prior = into / into.sum()
        steps = bigrams[:, :classes] + PRIOR * prior
        self.step = np.log10(steps / steps.sum(axis=1, keepdims=True))
        many = np.bincount(of[:-1], minlength=classes)[:classes]
        per_class = np.bincount(of[:-1], weights=type_counts, minlength=classes)[:classes]
        self.emit = np.log10((type_counts + ADD) / (per_class + ADD * many)[of[:-1]])
        # within a group each word has its count + ADD, and the unseen words together ADD
        first = len(types.words)
        self.group_log = np.log10(type_counts[first:] + ADD * (group_words + 1))
        self.base_log = np.log10(tokens + ADD * (distinct + 1))

    def score(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text: tokens, known tokens, base and model score as far as known here, and the words still to look up."""
        first = len(self.types.words)
        for h, g, d, lo, hi in tokenise(texts):
            n = hi - lo
            t = self.types.of(h, g)
            c = self.of[t]
            before = np.concatenate([[len(self.step) - 1], np.where(d[1:] == d[:-1], c[:-1], len(self.step) - 1)])
            at = np.minimum(np.searchsorted(self.sent, h), max(0, len(self.sent) - 1))
            here = self.sent[at] == h if len(self.sent) else np.zeros(len(h), bool)
            log_count = np.where(here, np.log10(self.counts[at] + ADD) if len(self.sent) else 0.0, 0.0)
            base = log_count - self.base_log
            rare = t >= first
            model = self.step[before, c] + self.emit[t] + np.where(rare, log_count - self.group_log[np.where(rare, t - first, 0)], 0.0)
            sums = [np.bincount(d, weights=x, minlength=n) for x in (base, model)]
            known = np.bincount(d, weights=here & (self.counts[at] > 0) if len(self.sent) else here, minlength=n)
            ask, whose = h[~here], d[~here]
            cuts = np.searchsorted(whose, np.arange(n + 1))
            yield np.bincount(d, minlength=n), known.astype(np.int64), *sums, ask, cuts


PARTS = "n_tokens long, known_here long, base_here double, score_here double, ask array<long>"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = list(model.score(batch.column("text").to_pylist()))
        if not parts:
            continue
        ask = np.concatenate([p[4] for p in parts])
        cuts, at = [], 0
        for p in parts:
            cuts.append(p[5][:-1] + at)
            at += p[5][-1]
        offsets = np.concatenate([*cuts, [at]]).astype(np.int32)
        new = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(4)]
        new.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(ask))))
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
        names = [n for n, _ in kept] + [x.split()[0] for x in PARTS.split(", ")]
        yield pa.RecordBatch.from_arrays([c for _, c in kept] + new, names)


def score(docs: DataFrame, learn_from: Column | None = None, keep: tuple[str, ...] = ("doc_id",), classes: int = CLASSES) -> DataFrame:
    """``keep`` with n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Learns from the rows where ``learn_from`` holds (all by default). ``score`` is the model's log10 probability of the
    text, so its perplexity is 10 ** (-score / n_tokens); ``base_score`` is that of single tokens with ADD added to counts.
    A null or empty text is one end token. A word is its ASCII-lower-cased bytes, known by a 64-bit hash. Repeated rows
    count and score repeatedly. Without training rows every word is unknown. Columns not kept are dropped.
    """
    c, spark = F.col, docs.sparkSession
    train = docs.filter(F.lit(True) if learn_from is None else learn_from).select("text")
    words = train.mapInArrow(_count, "word long, group int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("group").alias("group"))
    words = materialise(words, "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    # a million words at most, as each has one in a million tokens
    own = (c("n") >= max(LEAST, tokens * OWN)) & (c("group") >= 0) | (c("group") < 0)
    got = words.filter(own).toArrow()
    keys, counts, groups = (got.column(x).to_numpy() for x in ("word", "n", "group"))
    if not len(keys) or END not in keys.view(U64):  # nothing to learn from
        keys, counts, groups = _signed(np.append(keys.view(U64), END)), np.append(counts, 0), np.append(groups, -1)
    order = np.argsort(keys.view(U64))
    keys, counts, groups = keys.view(U64)[order], counts[order], groups[order]
    types, few = Types(keys), (counts >= tokens * FREQUENT) | (groups < 0)
    core = Types(keys[few])
    end = int(np.searchsorted(core.words, END))
    pairs = train.mapInArrow(lambda batches: _pairs(batches, core), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs, "pairs")
    got = pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    freq = np.zeros(core.many)
    freq[got.column("b").to_numpy()] = got.column("n").to_numpy()
    of_core = exchange(pairs, core.many, core.many, end, freq, classes)
    after, _ = _by_class(spark, pairs, of_core, core.many, classes)
    bigrams = np.zeros((classes + 1, classes + 1))
    np.add.at(bigrams, of_core, after)

    # every other type starts in its group's class
    of = np.concatenate([of_core[core.of(keys, groups)], of_core[len(core.words) :]])
    moving = np.concatenate([~few, np.zeros(GROUPS, bool)])
    if moving.any():
        sent = spark.sparkContext.broadcast((types, of, moving))
        near = train.mapInArrow(lambda batches: _contexts(batches, *sent.value), "t int, k int, n long").groupBy("t", "k").agg(F.sum("n").alias("n"))
        near = materialise(near.groupBy("t").agg(F.collect_list(F.struct("k", "n")).alias("near")), "contexts")
        of, _ = refine(near, of, bigrams)
        final = spark.sparkContext.broadcast((types, of))
        got = train.mapInArrow(lambda batches: _steps(batches, *final.value), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        bigrams = np.zeros((classes + 1) ** 2)
        bigrams[got.column("k").to_numpy()] = got.column("n").to_numpy()
        bigrams = bigrams.reshape(classes + 1, classes + 1)

    rest = words.filter(~own).groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).toArrow()
    group_words, group_tokens = np.zeros(GROUPS), np.zeros(GROUPS)
    if rest.num_rows:
        group_words[rest.column("group").to_numpy()] = rest.column("m").to_numpy()
        group_tokens[rest.column("group").to_numpy()] = rest.column("n").to_numpy()
    freq = np.concatenate([counts, group_tokens]).astype(float)
    model = spark.sparkContext.broadcast(Model(types, of, bigrams, freq, group_words, keys, counts, tokens, distinct, classes))

    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    parts = rows.mapInArrow(lambda batches: _score(batches, model.value), f"{fields}, {PARTS}" if fields else PARTS)
    parts = materialise(parts.withColumn("_row", F.monotonically_increasing_id()), "parts")
    asked = parts.select("_row", F.explode("ask").alias("w")).groupBy("w", "_row").agg(F.count(F.lit(1)).alias("tf"))
    asked = asked.join(words.filter(~own).select("word", "n"), c("w") == c("word"), "left")
    n = F.coalesce("n", F.lit(0))
    looked = asked.groupBy(c("_row").alias("_at")).agg(
        F.sum(c("tf") * F.log10(n + ADD)).alias("found"), F.sum(F.when(n > 0, c("tf")).otherwise(0)).alias("more")
    )
    out = parts.drop("ask").join(looked, c("_row") == c("_at"), "left")
    found = F.coalesce("found", F.lit(0.0))
    return out.select(
        *keep,
        "n_tokens",
        (c("known_here") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (c("base_here") + found).alias("base_score"),
        (c("score_here") + found).alias("score"),
    )
