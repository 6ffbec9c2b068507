"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text accepts exactly the strings that occur in it. A text is parsed
greedily: each phrase is the longest match with the language's text from where the last one ended. The fewer phrases, the
closer the language; phrases * log2(size of the labelled text) / length estimates the cross entropy in bits a character,
and the lowest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from .common import quoted

GAP, UNKNOWN, FIRST = 0, 1, 2  # symbols: anything between words, a letter the labelled text lacks, the letters
SEGMENT = 2048  # symbols parsed in one go; each segment begins a phrase, which adds one phrase at most
OWN = 1.5  # times the bits of a language's own text are still that language
SHARPNESS = 4.0  # of the score: the weight of a language is 2 ** (-SHARPNESS * bits)


def labelled_sample(docs: DataFrame, where: Column, per_language: int = 120, chars: int = 250) -> list[tuple[str, list[str]]]:
    """For each language, sorted, pieces of its texts: at most ``per_language`` rows and ``chars`` characters of each.

    The rows are those with the smallest hash of id and text, the piece starts at a place the hash gives. Nothing but this
    bounded sample reaches the driver: per_language * chars characters a language.
    """
    h = F.xxhash64("doc_id", "text")
    start = (F.pmod(h, F.greatest(F.lit(1), F.char_length("text") - chars)) + 1).cast("int")
    rows = docs.filter(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", h.alias("h"), F.substr("text", start, F.lit(chars)).alias("piece")).filter(F.trim("piece") != "")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "piece"))).filter(F.col("n") <= per_language)
    by: dict[str, list[tuple[int, str]]] = {}
    for r in first.collect():
        by.setdefault(r.lang, []).append((r.n, r.piece))
    return [(lang, [p for _, p in sorted(pieces)]) for lang, pieces in sorted(by.items())]


class Automata:
    """The languages' suffix automata as one table: row = state, column = symbol, entry = next row's offset or -1.

    Every letter of the labelled text has a symbol. The most frequent ones, ``symbols`` with the other two, are columns of
    the table; steps by any other letter are kept as sorted (state, symbol) keys, as a table of them would be mostly empty.
    """

    def __init__(self, sample: list[tuple[str, list[str]]], symbols: int = 64):
        self.langs = [lang for lang, _ in sample]
        counts: dict[str, int] = {}
        texts = [" ".join(pieces).lower() for _, pieces in sample]
        for text in texts:
            for c in set(text):
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + text.count(c)
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.many = FIRST + len(letters)
        self.width = min(self.many, symbols)
        self.symbol = np.array([UNKNOWN if chr(c).isalpha() else GAP for c in range(0x110000)], np.min_scalar_type(self.many))
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = FIRST + i
        tables, keys, ends, begins, self.roots, self.log_size, at = [], [], [], [], [], [], 0
        for text in texts:
            s = self.encode(text)
            steps = self._automaton(s.tolist())
            table = np.full((len(steps), self.width), -1, np.int64)
            for i, d in enumerate(steps):
                for c, to in d.items():
                    if c < self.width:
                        table[i, c] = (to + at) * self.width
                    else:
                        keys.append((i + at) * self.width * self.many + c)
                        ends.append((to + at) * self.width)
            tables.append(table)
            self.roots.append(at * self.width)
            self.log_size.append(np.log2(max(2, len(s))))
            # a symbol that no phrase can begin with is a phrase of its own
            begins.append([(steps[0].get(c, 0) + at) * self.width for c in range(self.many)])
            at += len(steps)
        kind = np.int32 if at * self.width < 2**31 else np.int64
        self.next = np.concatenate(tables).astype(kind).ravel() if tables else np.zeros(0, kind)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ends = np.array(keys, np.int64)[order], np.array(ends, kind)[order]
        self.begin = np.array(begins, kind)

    def encode(self, lowered: str) -> np.ndarray:
        s = self.symbol[np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s != GAP
        if len(s):
            keep[1:] |= s[:-1] != GAP  # one gap for a run of them
        return s[keep]

    def _automaton(self, s: list[int]) -> list[dict[int, int]]:
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in s:
            if c == UNKNOWN:
                last = 0
                continue
            if c in step[last] and length[step[last][c]] == length[last] + 1:
                last = step[last][c]  # after an unknown letter the automaton goes on from its root
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        return step

    def _step(self, now: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The state after ``now`` by language and segment, -1 if there is none."""
        if not len(self.keys):
            return self.next[now + c]
        to = self.next[now + np.where(c < self.width, c, UNKNOWN)]
        rare = np.flatnonzero(c >= self.width)
        if len(rare):
            key = now[:, rare].astype(np.int64) * self.many + c[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[:, rare] = np.where(self.keys[at] == key, self.ends[at], -1)
        return to

    def phrases(self, segments: list[np.ndarray]) -> np.ndarray:
        """Number of phrases, by language and segment. All segments and languages take one step at a time together."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        sizes = np.array([len(segments[i]) for i in order])
        longest, n = int(sizes[0]), len(order)
        grid = np.zeros((longest, n), self.symbol.dtype)
        for j, i in enumerate(order):
            grid[: len(segments[i]), j] = segments[i]
        left = np.searchsorted(-sizes, -np.arange(longest), side="left")  # segments longer than t
        count = np.zeros((len(self.roots), n), np.int32)
        root = np.array(self.roots, self.next.dtype)[:, None]
        state = np.repeat(root, n, axis=1)
        for t in range(longest):
            k = left[t]
            c = grid[t, :k]
            now = state[:, :k]
            to = self._step(now, c)
            miss = to < 0
            count[:, :k] += miss | (now == root)
            state[:, :k] = np.where(miss, self.begin[:, c], to)
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language or und, score, bits a character) of whole texts. Bits leave the first phrase out, which any text needs."""
        out: list[tuple[str, float, float | None]] = [("und", 0.0, None)] * len(texts)
        if not self.langs:
            return out
        pending, size = [], 0
        for i, text in enumerate(texts):
            s = self.encode((text or "").lower())
            if (s != GAP).any():
                pending.append((i, s))
                size += len(s)
            if size >= 1_000_000 or (i == len(texts) - 1 and pending):
                self._decide(pending, out)
                pending, size = [], 0
        return out

    def _decide(self, pending, out) -> None:
        segments, owner = [], []
        for j, (_, s) in enumerate(pending):
            for lo in range(0, len(s), SEGMENT):
                segments.append(s[lo : lo + SEGMENT])
                owner.append(j)
        total = np.zeros((len(self.langs), len(pending)))
        np.add.at(total, (slice(None), np.array(owner)), self.phrases(segments))
        bits = total * np.array(self.log_size)[:, None] / np.array([len(s) for _, s in pending])
        best = bits.argmin(axis=0)
        weight = 2.0 ** (-SHARPNESS * (bits - bits.min(axis=0)))
        score = weight.max(axis=0) / weight.sum(axis=0)
        for j, (i, s) in enumerate(pending):
            beyond = (total[best[j], j] - 1) * self.log_size[best[j]] / len(s)
            out[i] = (self.langs[best[j]], float(score[j]), float(beyond))


_READY: dict[int, Automata] = {}  # one per worker process: built once from the broadcast sample


def _predict(batches: Iterator[pa.RecordBatch], sample) -> Iterator[pa.RecordBatch]:
    if sample.id not in _READY:
        _READY.clear()
        _READY[sample.id] = Automata(sample.value)
    automata = _READY[sample.id]
    for batch in batches:
        got = automata.predict(batch.column("text").to_pylist())
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
        new = [
            ("lang_pred", pa.array([g[0] for g in got], pa.string())),
            ("score", pa.array([g[1] for g in got], pa.float64())),
            ("bits", pa.array([g[2] for g in got], pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays([c for _, c in kept + new], [n for n, _ in kept + new])


class _Sample:
    """The broadcast sample with a name by which a worker knows what it has built."""

    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id(), broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"id": self.id, "broadcast": self.broadcast}


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def identify(docs: DataFrame, learn_from: Column | None = None, keep: tuple[str, ...] = ("doc_id",), per_language: int = 120, chars: int = 250) -> DataFrame:
    """``keep`` with lang_pred, score and bits for every whole text.

    Learns from a bounded sample of the rows ``learn_from`` (all by default) that have a lang; needs doc_id, text, lang.
    Texts that are null or have no letter are ``und`` with score 0, as is everything if nothing is labelled. Letters
    compare without case. Ties go to the language first in code point order. Further columns are dropped unless kept.
    """
    sample = labelled_sample(docs, F.lit(True) if learn_from is None else learn_from, per_language, chars)
    return _identify(docs, sample, keep)


def _identify(docs: DataFrame, sample: list[tuple[str, list[str]]], keep: tuple[str, ...]) -> DataFrame:
    shared = _Sample(docs.sparkSession.sparkContext.broadcast(sample))
    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    fields = [f for f in rows.schema if f.name != "text"]
    added = StructType.fromDDL("lang_pred string, score double, bits double")
    return rows.mapInArrow(lambda batches: _predict(batches, shared), StructType([*fields, *added]))


def own_bits(sample: list[tuple[str, list[str]]]) -> dict[str, float]:
    """Bits a character that a language's own text needs: the median of every other piece, parsed with the rest."""
    out = {}
    for lang, pieces in sample:
        if len(pieces) == 1:
            half = len(pieces[0]) // 2
            pieces = [pieces[0][:half], pieces[0][half:]]
        bits = [b for _, _, b in Automata([(lang, pieces[::2])]).predict(pieces[1::2]) if b is not None]
        if bits:
            out[lang] = float(np.median(bits))
    return out


def keep_known(docs: DataFrame, most_bits: float = 6.0, learn_from: Column | None = None, per_language: int = 120, chars: int = 250) -> DataFrame:
    """The rows of ``docs`` in a language that was learned: ``und`` goes, and so does text that no language explains.

    ``most_bits`` is the cross entropy a character beyond which a text counts as no language; a text of random letters
    needs about log2(size of the labelled text) / 2 bits or more. Where a language's own text comes near it, as with
    thousands of letters, the limit is OWN times what that text needs (own_bits). The other columns stay as they are.
    """
    sample = labelled_sample(docs, F.lit(True) if learn_from is None else learn_from, per_language, chars)
    limits = {lang: OWN * bits for lang, bits in own_bits(sample).items() if OWN * bits > most_bits}
    limit = F.lit(most_bits)
    for lang, bits in limits.items():
        limit = F.when(F.col("lang_pred") == lang, bits).otherwise(limit)
    got = _identify(docs.select("text", F.struct(*[quoted(x) for x in docs.columns]).alias("_all")), sample, ("_all",))
    return got.filter((F.col("lang_pred") != "und") & (F.col("bits") <= limit)).select("_all.*")
