"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is a sequence of words: runs of letters, of digits, and of other marks. N-grams of the words themselves and of their
shapes (case, kind, whether a word repeats one just before it) are hashed to a fixed number of features, so no vocabulary is
kept; a score is one sparse dot product with the weights.

Training deals a bounded sample of labelled texts to a fixed number of shards. In each round every shard runs the updates
over its rows in order, and the shards' states are averaged. Rows go to shards and into order by hashes of their content, so
reruns on any cluster learn the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import materialise, quoted
from .neardup import BASE, BASE_INVERSE, BYTE, U64, _power, cut, mix64

BITS = 18
FEATURES = 1 << BITS
MOST_ROWS = 8_000  # labelled texts learned from
SHARDS, ROUNDS = 8, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 1.0  # of the updates

# kinds of bytes: blanks, letters (all bytes beyond ASCII among them), digits, marks
KIND = np.full(256, 3, np.int8)
KIND[[32, 9, 10, 11, 12, 13]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
CAPITAL = np.zeros(256, np.int64)
CAPITAL[65:91] = 1
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
GOLDEN = U64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, ASCII case folded, and one for its shape."""
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]]).astype(np.int8)))
    start, end = edges[:-1], edges[1:]
    inside = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[inside], end[inside]
    if len(start) == 0:
        return np.zeros(0, U64), np.zeros(0, U64)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[FOLD[raw]] * _power(BASE, len(raw)), dtype=U64)])
    word = mix64((total[end] - total[start]) * _power(BASE_INVERSE, len(raw))[start] + (end - start).astype(U64))
    capitals = np.concatenate([[0], np.cumsum(CAPITAL[raw])])
    upper = capitals[end] - capitals[start]
    first = CAPITAL[raw[start]]
    of = kind[start].astype(np.int64)
    # letters: no capital, a capital in front, all capitals, mixed; digits; marks are told apart
    case = np.where(upper == 0, 0, np.where((upper == 1) & (first == 1), 1, np.where(upper == end - start, 2, 3)))
    shape = np.where(of == 1, case, 4).astype(U64)
    shape = np.where(of == 3, word, shape)
    repeats = np.zeros(len(word), bool)
    for back in (1, 2):
        repeats[back:] |= (word[back:] == word[:-back]) & (of[back:] == 1)
    return word, mix64(shape * U64(2) + repeats)


def grams(h: np.ndarray, longest: int, salt: int) -> np.ndarray:
    """The features of all n-grams of 1 to ``longest``."""
    out, x = [], mix64(h + U64(salt))
    for n in range(longest):
        if n:
            x = mix64(x[:-1] * GOLDEN + h[n:])
        out.append((x >> U64(64 - BITS)).astype(np.int64))
        if len(x) < 2:
            break
    return np.concatenate(out)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their values: logarithms of counts, brought to length 1 for words and for shapes each.

    The whole text counts; a very long one is read in pieces that end between words, whose n-grams do not span pieces.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    pieces = [words_of(p) for p in cut(data)]
    at, values = [], []
    for view, (longest, salt) in enumerate(((2, 1), (3, 2))):
        if len(pieces) == 1 and len(pieces[0][view]):
            i, n = np.unique(grams(pieces[0][view], longest, salt), return_counts=True)
        else:
            n = np.zeros(FEATURES, np.int64)
            for p in pieces:
                if len(p[view]):
                    n += np.bincount(grams(p[view], longest, salt), minlength=FEATURES)
            i = np.flatnonzero(n)
            n = n[i]
        v = np.log1p(n)
        at.append(i)
        values.append(v / max(1e-12, np.sqrt((v * v).sum())))
    i, back = np.unique(np.concatenate(at), return_inverse=True)
    return i, np.bincount(back, weights=np.concatenate(values), minlength=len(i))


@dataclass
class State:
    """What the updates keep, for each feature and, last, the constant: z and n."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls) -> "State":
        return cls(np.zeros(FEATURES + 1), np.zeros(FEATURES + 1))

    def weights(self, i=slice(None)) -> np.ndarray:
        z = self.z[i]
        return -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2) * (np.abs(z) > L1)

    def learn(self, i: np.ndarray, x: np.ndarray, label: int) -> None:
        i, x = np.append(i, FEATURES), np.append(x, 1.0)
        w = self.weights(i)
        g = (probability(w @ x) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def probability(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column(c) for c in ("h", "label")]
        columns.append(pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())))
        columns.append(pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32())))
        yield pa.RecordBatch.from_arrays(columns, ["h", "label", "at", "value"])


def _one_round(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The updates over the shards of this task, which come sorted: each shard's state at its end."""
    shard, state = None, None

    def closed():
        return pa.RecordBatch.from_pydict({"z": [state.z.tobytes()], "n": [state.n.tobytes()]})

    for batch in batches:
        at, value = batch.column("at"), batch.column("value")
        for row, (s, label) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist())):
            if s != shard:
                if state:
                    yield closed()
                shard, state = s, State(*(a.copy() for a in shared.value))
            state.learn(at[row].values.to_numpy(), value[row].values.to_numpy().astype(np.float64), label)
    if state:
        yield closed()


def learn(docs: DataFrame, labels: DataFrame, where: Column | None = None, most_rows: int = MOST_ROWS, shards: int = SHARDS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the features and, last, of the constant, from labels (doc_id, quality) of rows where ``where`` holds.

    Learns from the ``most_rows`` labelled ids with the smallest hashes: each text and label of theirs, equal ones once. Labels
    other than 0 and 1 and null ids are passed over. Without any, all weights are 0.
    """
    spark = docs.sparkSession
    c = F.col
    known = labels.select(c("doc_id").alias("of"), c("quality").try_cast("int").alias("label")).filter("of IS NOT NULL AND label IN (0, 1)")
    rows = docs.filter(F.lit(True) if where is None else where).select(c("doc_id").alias("id"), "text")
    # ids only: the few that are learned from, a bounded number
    both = known.join(rows.select("id"), c("of") == c("id"), "left_semi").select("of").distinct()
    few = both.orderBy(F.xxhash64("of"), "of").limit(most_rows)
    few = known.join(F.broadcast(few.withColumnRenamed("of", "few")), c("of") == c("few"), "left_semi")
    few = materialise(few, "labels")
    taken = rows.join(F.broadcast(few) if few.count() <= 4 * most_rows else few, c("of") == c("id"))
    taken = taken.select(F.xxhash64("id", "text", "label").alias("h"), "label", "text").repartition(4 * shards, "h").dropDuplicates(["h"])
    examples = materialise(taken.mapInArrow(_featured, "h long, label int, at array<int>, value array<float>"), "examples")
    state = State.new()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((state.z, state.n))
        dealt = examples.withColumn("shard", F.pmod("h", F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "h")
        got = dealt.mapInArrow(lambda batches: _one_round(batches, shared), "z binary, n binary").collect()
        if got:
            # in one order, so that the sums are the same in every run
            states = sorted((bytes(r.z), bytes(r.n)) for r in got)
            state = State(*(np.mean([np.frombuffer(s[k]) for s in states], axis=0) for k in (0, 1)))
    return state.weights()


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    w = shared.value
    for batch in batches:
        scores = []
        for text in batch.column("text").to_pylist():
            i, x = features(text)
            scores.append(float(probability(w[i] @ x + w[-1])))
        columns = [batch.column("kept"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["kept", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """``keep`` with score (the probability of label 1) and predicted (1 from 0.5 on) of every whole text.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; learns from the rows where ``learn_from`` holds (all by
    default), see ``learn``. Null and empty texts score by the constant alone. Equal texts score alike; repeated rows give
    repeated results. Without labels every score is 0.5. Columns not kept are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, learn_from, **how).astype(np.float64))
    rows = docs.select(F.struct(*[quoted(c) for c in keep]).alias("kept"), "text")
    schema = StructType([rows.schema["kept"], *StructType.fromDDL("score double, predicted int")])
    return rows.mapInArrow(lambda batches: _scored(batches, shared), schema).select("kept.*", "score", "predicted")
