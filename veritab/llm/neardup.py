"""MinHash near-dedup with tensored banding.

Two small collections of bands are computed, ``side`` bands of ``rows`` minhashes each. Every pair of a band of the first
and a band of the second forms the key of a table: side * side tables from 2 * side * rows minhashes, where independent
tables would need side * side * 2 * rows. Texts that meet in a table are candidates, and candidates count only once the
full shingle sets confirm them.

No group is expanded into its pairs. Texts with equal sets become one node first. Then each table bucket proposes one member
as partner to all others, which settles groups of copies with one pair per member; after that only members of different
components are paired, and only where their odd sketches leave a link possible, so that no link between texts is lost
because its group was large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import content_key, materialise, quoted

U64 = np.uint64
_rng = np.random.default_rng(20240613)
BYTE = _rng.integers(1, 2**63, 256, dtype=U64)
BASE = int(_rng.integers(2**61, 2**62)) | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
CHUNK = 2_000_000  # bytes of text hashed in one go


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, out * U64(pow(base, len(out), 2**64))])
    return out[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the text, ASCII case folded, and where the words start and end."""
    b = LOW[np.frombuffer(data, np.uint8)]
    inside = ~BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start) == 0:
        return np.zeros(0, U64), start, end
    # words as polynomials: differences of running sums, brought back to power 0
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[b] * _power(BASE, len(b)), dtype=U64)])
    value = (total[end] - total[start]) * _power(BASE_INVERSE, len(b))[start]
    return mix64(value + (end - start).astype(U64)), start, end


def cut(data: bytes) -> list[bytes]:
    """A long text in pieces of about CHUNK bytes that end between words."""
    out, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        out.append(data[at:end])
        at = end
    return out


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = _powers(base, max(n, 1 << 16))
    return _POWERS[base][:n]


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words as sorted 64-bit hashes; a shorter text is one shingle, no words none."""
    w = [hash_words(piece)[0] for piece in cut((text or "").encode("utf-8", "surrogatepass"))]
    w = np.concatenate(w) if w else np.zeros(0, U64)
    if len(w) == 0:
        return w
    n = min(size, len(w))
    h = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    # the number of words keeps a short text apart from the shingles of others
    return np.unique(h + U64(n))


class Bands:
    def __init__(self, side: int, rows: int):
        self.side, self.rows = side, rows
        seeds = np.random.default_rng(7).integers(1, 2**63, 2 * side * rows, dtype=U64)
        self.add, self.times = seeds, mix64(seeds) | U64(1)

    def minhashes(self, s: np.ndarray) -> np.ndarray:
        # shingles are well spread already, so one multiplication with carry-down of the high half is a fresh order
        out = np.empty(len(self.add), U64)
        for i, (a, m) in enumerate(zip(self.add, self.times)):
            x = (s ^ a) * m
            out[i] = (x ^ (x >> U64(32))).min()
        return out

    def bands(self, mh: np.ndarray) -> np.ndarray:
        """side bands of the first collection, then side of the second."""
        out = np.zeros(2 * self.side, U64)
        parts = mh.reshape(2 * self.side, self.rows)
        for r in range(self.rows):
            out = mix64(out * U64(0x9E3779B97F4A7C15) + parts[:, r])
        return out


SIGNED = "doc_id long, ca long, cb long, n_shingles long, set_a long, set_b long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch], size: int, side: int, rows: int) -> Iterator[pa.RecordBatch]:
    maker = Bands(side, rows)
    for batch in batches:
        n, sets, bands = [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py(), size)
            n.append(len(s))
            if len(s) == 0:
                sets.append((None, None))
                bands.append(None)
                continue
            a = np.bitwise_xor.reduce(mix64(s + U64(1)))
            b = np.add.reduce(mix64(s ^ U64(0xD6E8FEB86659FD93)), dtype=U64)
            sets.append((int(a.view(np.int64)), int(b.view(np.int64))))
            bands.append(maker.bands(maker.minhashes(s)).view(np.int64))
        long = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "ca", "cb")),
                pa.array(n, long),
                pa.array([x for x, _ in sets], long),
                pa.array([x for _, x in sets], long),
                pa.array(bands, pa.list_(long)),
            ],
            names=[f.split()[0] for f in SIGNED.split(", ")],
        )


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have 100 * intersection >= percent * union. Rows come by ``a``, so its set is made once."""
    last, one = None, None
    for batch in batches:
        keep = []
        for i, (a, x, y) in enumerate(zip(batch.column("a"), batch.column("text_a"), batch.column("text_b"))):
            if a != last:
                last, one = a, shingles(x.as_py(), size)
            other = shingles(y.as_py(), size)
            common = len(np.intersect1d(one, other, assume_unique=True))
            if 100 * common >= percent * (len(one) + len(other) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])


ODD = [f"o{i}" for i in range(8)]
FACTS = "node long, n long, " + ", ".join(f"{o} long" for o in ODD)


def _odd(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Per node the size of its set and its odd sketch: of 512 bits, those that an odd number of its shingles fall on."""
    for batch in batches:
        n, rows = [], np.zeros((batch.num_rows, len(ODD)), U64)
        for i, text in enumerate(batch.column("text")):
            s = shingles(text.as_py(), size)
            n.append(len(s))
            place = mix64(s ^ U64(0xA24BAED4963EE407)) & U64(511)
            odd = np.bincount(place.astype(np.int64), minlength=512) & 1
            rows[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)
        cols = [pa.array(rows[:, i].view(np.int64)) for i in range(len(ODD))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int64()), *cols], names=["node", "n", *ODD])


def _can_link(one: str, other: str, percent: int) -> Column:
    """False only where a link is impossible. Suffixes name the columns of the two nodes.

    Sets linked at t differ in (1 - t) / (1 + t) of their sizes' sum at most, and each bit in which two odd sketches differ
    takes an element of the difference; no link fails this.
    """
    c = F.col
    n1, n2 = c(f"n{one}"), c(f"n{other}")
    bits = sum((F.bit_count(c(f"{o}{one}").bitwiseXOR(c(f"{o}{other}"))) for o in ODD), F.lit(0))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (bits * (100 + percent) <= (n1 + n2) * (100 - percent))


def _first_shared(start: int, many: int) -> Column:
    """The first of the bands from ``start`` on that both nodes of a pair have."""
    same = lambda i: F.get("bands", F.lit(i)) == F.get("bands_", F.lit(i))
    return F.coalesce(*[F.when(same(start + i), F.lit(i)) for i in range(many)])


def components(links: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (a, b), for all ``nodes`` (node).

    Every round each node takes the smallest label among its own and its neighbours', and then its label's label, so
    chains shorten by half; labels are aggregated per node before they meet, so hubs are no hot keys. Rounds end when
    nothing changes.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-links")
    if both.isEmpty():
        return nodes.select("node", F.col("node").alias("comp"))
    state = materialise(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), f"{label}-0")
    step = 0
    while True:
        step += 1
        offered = both.join(state, F.col("a") == F.col("node")).groupBy(F.col("b").alias("n")).agg(F.min("comp").alias("low"))
        lower = state.join(offered, F.col("node") == F.col("n"), "left").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        jump = state.select(F.col("node").alias("m"), F.col("comp").alias("further"))
        new = lower.join(jump, F.col("comp") == F.col("m"), "left").select("node", "was", F.least("comp", "further").alias("comp"))
        new = materialise(new, f"{label}-{step}")
        changed = new.filter("was <> comp").limit(1).count()
        state = new.drop("was")
        if not changed:
            break
    linked = state.select(F.col("node").alias("n"), "comp")
    return nodes.join(linked, F.col("node") == F.col("n"), "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ca and cb, which name a row by its id and text."""
    return docs.withColumn("_key", content_key("doc_id", "text")).select("*", F.col("_key.a").alias("ca"), F.col("_key.b").alias("cb")).drop("_key")


def signatures(docs: DataFrame, size: int, side: int, rows: int) -> DataFrame:
    """Per row: its names, the number of its shingles, set_a and set_b that name the set, its bands and its sketch."""
    rows_ = _keyed(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), "ca", "cb", "text")
    return rows_.mapInArrow(lambda batches: _sign(batches, size, side, rows), SIGNED)


def linked(docs: DataFrame, size: int = 5, percent: int = 80, side: int = 8, rows: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, ca, cb, n_shingles, group; ``group`` is null for texts without words.

    Two texts at similarity j meet in a table with probability (1 - (1 - j^rows)^side)^2: 0.99993 at 0.85, 0.9994 at 0.8
    with the default 8 * 8 tables, more above. Candidates that sizes or odd sketches show to be too far apart are not read;
    that loses no link.
    """
    c = F.col
    signed = materialise(signatures(docs, size, side, rows), "signed")
    by_set = ["set_a", "set_b"]
    sets = signed.filter("n_shingles > 0").groupBy(*by_set).agg(
        F.min(F.struct("ca", "cb")).alias("row"), F.first("bands").alias("bands")
    )
    nodes = materialise(sets.withColumnRenamed("set_a", "node"), "sets")

    tables = [F.xxhash64(F.lit(i * side + j), F.get("bands", F.lit(i)), F.get("bands", F.lit(side + j))) for i in range(side) for j in range(side)]
    keyed = nodes.select("node", F.posexplode(F.array(*tables)).alias("table", "key"))
    # most buckets hold one node; only the others go on
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    bucket = materialise(keyed.join(shared.select(c("key").alias("k")), c("key") == c("k")).drop("k"), "buckets")

    # the texts of nodes in shared buckets, once; rows with equal sets share one
    wanted = nodes.select("node", c("row.ca").alias("x"), c("row.cb").alias("y")).join(bucket.select("node").distinct(), "node", "left_semi")
    texts = _keyed(docs.select("doc_id", "text")).join(wanted, (c("ca") == c("x")) & (c("cb") == c("y")))
    texts = materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    facts = materialise(texts.mapInArrow(lambda batches: _odd(batches, size), FACTS), "facts")

    def possible(pairs: DataFrame) -> DataFrame:
        one = facts.select(*[c(x).alias(f"{x}_a") for x in facts.columns])
        other = facts.select(*[c(x).alias(f"{x}_b") for x in facts.columns])
        both = pairs.join(one, c("a") == c("node_a")).join(other, c("b") == c("node_b"))
        return both.filter(_can_link("_a", "_b", percent)).select("a", "b")

    # The centre of a bucket is the node with most company over all tables: in a group of copies, the one they come from.
    company = bucket.join(bucket.groupBy(c("key").alias("k")).agg(F.count(F.lit(1)).alias("members")), c("key") == c("k"))
    company = company.groupBy(c("node").alias("m")).agg(F.sum("members").alias("company"))
    centres = bucket.join(company, c("node") == c("m")).groupBy(c("key").alias("k")).agg(F.max_by("node", F.struct("company", "node")).alias("centre"))
    first = bucket.join(centres, c("key") == c("k")).filter("node <> centre")
    first = first.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    first = materialise(possible(first), "pairs-1")

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        one = texts.select(c("node").alias("x"), c("text").alias("text_a"))
        other = texts.select(c("node").alias("y"), c("text").alias("text_b"))
        both = pairs.join(other, c("b") == c("y")).join(one, c("a") == c("x")).select("a", "b", "text_a", "text_b")
        return materialise(both.mapInArrow(lambda batches: _confirm(batches, size, percent), "a long, b long"), label)

    links = confirmed(first, "links-1")
    comp = materialise(components(links, nodes.select("node"), "round-1"), "comp-1")
    # Where a bucket's members are still apart: those outside its largest component against all its others.
    placed = bucket.join(comp, "node")
    counts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = materialise(placed.join(main.select(c("key").alias("k"), "main"), c("key") == c("k")).drop("k").join(facts, "node"), "open")
    open_ = open_.join(nodes.select("node", "bands"), "node")
    outside = open_.filter("comp <> main").select(*[c(x).alias(f"{x}_") for x in ("key", "comp", "bands", *facts.columns)])
    # a pair comes up once: in the first of the tables it shares
    once = c("table") == _first_shared(0, side) * side + _first_shared(side, side)
    second = outside.join(open_, (c("key_") == c("key")) & (c("comp_") != c("comp")) & once & _can_link("_", "", percent))
    second = second.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()
    second = materialise(second.join(first, ["a", "b"], "left_anti"), "pairs-2")
    if not second.isEmpty():
        more = confirmed(second, "links-2")
        comp = materialise(components(links.union(more), nodes.select("node"), "round-2"), "comp-2")
    named = nodes.select(c("node").alias("set_a"), "set_b").join(comp, c("set_a") == c("node")).select(*by_set, c("comp").alias("group"))
    return signed.select("doc_id", "ca", "cb", "n_shingles", *by_set).join(named, by_set, "left").drop(*by_set)


def cluster(docs: DataFrame, size: int = 5, percent: int = 80, side: int = 8, rows: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of ``size`` words (ASCII case folded; fewer words: all of them as one). Two
    texts are linked if 100 * intersection >= percent * union; component_id is the smallest doc_id reachable. Texts
    without words are linked with nothing. A null doc_id takes part but names no component: where all ids of a component
    are null so is its id, and kept is false. Repeated rows give repeated results. Sets are compared by 64-bit hashes of
    their shingles. See ``linked`` for the chance of missing a link.
    """
    c = F.col
    rows_ = materialise(linked(docs, size, percent, side, rows), "linked")
    ids = rows_.filter("group IS NOT NULL").groupBy(c("group").alias("g")).agg(F.min("doc_id").alias("lowest"))
    component = F.when(c("group").isNotNull(), c("lowest")).otherwise(c("doc_id"))
    out = rows_.join(ids, c("group") == c("g"), "left").withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(c("doc_id") == component, F.lit(False)).alias("kept"))


def dedupe(docs: DataFrame, size: int = 5, percent: int = 80, **how) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id (null ids last); columns stay.

    Of repeated rows (same id and text) any one stays. Texts without words are no copies of each other and all stay.
    """
    c = F.col
    rows = materialise(linked(docs, size, percent, **how), "linked")
    order = F.struct(c("doc_id").isNull(), c("doc_id"), c("ca"), c("cb"))
    first = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("o")).select(c("o.ca").alias("x"), c("o.cb").alias("y"))
    wordless = rows.filter("group IS NULL").select(c("ca").alias("x"), c("cb").alias("y")).distinct()
    stay = first.withColumn("one", F.lit(True)).union(wordless.withColumn("one", F.lit(False)))
    kept = _keyed(docs.select("doc_id", "text", F.struct(*[quoted(x) for x in docs.columns]).alias("_all"))).select("_all", "ca", "cb").join(stay, (c("ca") == c("x")) & (c("cb") == c("y")))
    again = F.row_number().over(W.partitionBy("ca", "cb").orderBy("ca", "cb"))
    return kept.withColumn("again", again).filter("again = 1 OR NOT one").select("_all.*")
