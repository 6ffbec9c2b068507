"""How the sources of a language differ in their terms: an audit by chunk factorization.

Texts are cut at blanks only, and chunks are counted per document. All counts of a chunk then meet side by side, so its terms
are found once, whatever the number of documents that hold it, and joined to its counts there. Terms are in turn brought
together by language; those in enough documents are kept.

Documents are counted exactly without listing them all: what matters is whether a term has LEAST of them, so a chunk or a
term carries LEAST ids of different documents at most. Every step streams over sorted rows; it holds a bounded number of
counts, summed in arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import materialise
from .neardup import CHUNK, cut

# Terms are [^\x00-\x40\x5B-\x60\x7B-\x7F]+, in UTF-8 these bytes; A to Z lower-cased, line ends kept, all else a blank
LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in LETTERS or c == 10 else 32 for c in range(256))
LEAST = 30  # documents of a language that keep a term
ADD, SCALE = 5, 1_000_000_000  # added to counts; p is in parts of SCALE
TOP = 50  # terms reported of a group
HELD = 1_500_000  # counts held by a task before they are passed on
BLOCK, TERMS = 512, 4096  # sources and terms compared at once

COUNTED = "key binary, lang string, counts binary"
KEPT = "lang string, term binary, of long, n long"


@dataclass
class Part:
    """Rows (lang, key) with counts by source, as (row, source, n), and ids of documents, as (row, id)."""

    key: pa.Array
    lang: pa.Array
    count: tuple[np.ndarray, np.ndarray, np.ndarray]
    doc: tuple[np.ndarray, np.ndarray]

    def __len__(self):
        return len(self.key)

    @classmethod
    def joined(cls, parts: list["Part"], least: int) -> "Part":
        """One row for each (lang, key), in the order of their keys' first appearance: counts summed, ``least`` different
        documents at most."""
        key = pa.concat_arrays([p.key for p in parts]).dictionary_encode()
        lang = pa.concat_arrays([p.lang for p in parts]).dictionary_encode()
        langs = max(1, len(lang.dictionary))
        named, row = np.unique(key.indices.to_numpy().astype(np.int64) * langs + lang.indices.to_numpy(), return_inverse=True)
        begin = np.cumsum([0] + [len(p) for p in parts])
        at = row[np.concatenate([p.count[0] + b for p, b in zip(parts, begin)])]
        sources, source = np.unique(np.concatenate([p.count[1] for p in parts]), return_inverse=True)
        both = at * max(1, len(sources)) + source
        order = np.argsort(both, kind="stable")
        first = _firsts(both[order])
        n = np.concatenate([p.count[2] for p in parts])[order]
        count = (at[order][first], sources[source[order][first]], np.add.reduceat(n, first) if len(first) else n)
        at = row[np.concatenate([p.doc[0] + b for p, b in zip(parts, begin)])]
        doc = np.concatenate([p.doc[1] for p in parts])
        order = np.lexsort((doc, at))
        at, doc = at[order], doc[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        at, doc = at[new], doc[new]
        few = np.arange(len(at)) - np.searchsorted(at, at) < least
        take = lambda a, i: a.dictionary.take(pa.array(i))
        return cls(take(key, named // langs), take(lang, named % langs), count, (at[few], doc[few]))

    def split(self, rows: int) -> tuple["Part", "Part"]:
        """The first ``rows`` rows and the others."""
        out = []
        for keep, less in ((slice(0, rows), 0), (slice(rows, len(self)), rows)):
            inside = [(x[0] < rows) == (less == 0) for x in (self.count, self.doc)]
            count = (self.count[0][inside[0]] - less, self.count[1][inside[0]], self.count[2][inside[0]])
            doc = (self.doc[0][inside[1]] - less, self.doc[1][inside[1]])
            out.append(Part(self.key[keep], self.lang[keep], count, doc))
        return out[0], out[1]

    def pack(self) -> pa.RecordBatch:
        """A row's counts and ids as one binary value of 64-bit numbers: how many counts, their sources, their n, the ids."""
        rows = len(self)
        counts, docs = np.bincount(self.count[0], minlength=rows), np.bincount(self.doc[0], minlength=rows)
        at = np.concatenate([[0], np.cumsum(1 + 2 * counts + docs)])
        out = np.empty(at[-1], np.int64)
        out[at[:-1]] = counts
        in_row = np.arange(len(self.count[0])) - np.repeat(np.cumsum(counts) - counts, counts)
        place = at[self.count[0]] + 1 + in_row
        out[place] = self.count[1]
        out[place + counts[self.count[0]]] = self.count[2]
        in_row = np.arange(len(self.doc[0])) - np.repeat(np.cumsum(docs) - docs, docs)
        out[at[self.doc[0]] + 1 + 2 * counts[self.doc[0]] + in_row] = self.doc[1]
        packed = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at * 8), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays([self.key, self.lang, packed.cast(pa.binary())], COUNTED.replace(" binary", "").replace(" string", "").split(", "))

    @classmethod
    def unpack(cls, batch: pa.RecordBatch) -> "Part":
        packed = batch.column("counts").cast(pa.large_binary())
        at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 8
        data = np.frombuffer(packed.buffers()[2] or b"", np.int64)
        counts = data[at[:-1]]
        docs = np.diff(at) - 1 - 2 * counts
        row = np.repeat(np.arange(len(packed)), counts)
        place = at[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        whose = np.repeat(np.arange(len(packed)), docs)
        ids = at[whose] + 1 + 2 * counts[whose] + np.arange(len(whose)) - np.repeat(np.cumsum(docs) - docs, docs)
        return cls(batch.column("key"), batch.column("lang"), (row, data[place], data[place + counts[row]]), (whose, data[ids]))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Texts, some CHUNK bytes at a time, with the numbers of their rows; a longer text comes in pieces cut at blanks."""
    text = batch.column("text")
    upto = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(text):
        begin = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, begin + CHUNK, side="right")))
        if hi == lo + 1 and upto[lo] - begin > CHUNK:
            for piece in cut(text[lo].as_buffer().to_pybytes()):
                yield np.array([lo]), pa.array([piece], pa.binary())
        else:
            yield np.arange(lo, hi), text[lo:hi]
        lo = hi


def _count_chunks(batches: Iterator[pa.RecordBatch], least: int, held: int) -> Iterator[pa.RecordBatch]:
    """Chunks per document, summed per task."""
    parts: list[Part] = []
    for batch in batches:
        doc, source = batch.column("doc").to_numpy(), batch.column("of").to_numpy()
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)
        for rows, texts in _pieces(batch):
            split = pc.ascii_split_whitespace(texts.cast(pa.string(), safe=False) if texts.type != pa.string() else texts)
            chunks = split.flatten().dictionary_encode()
            whose = np.repeat(np.arange(len(rows)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            if len(whose) == 0:
                continue
            pairs = np.sort(chunks.indices.to_numpy().astype(np.int64) * len(rows) + whose)
            first = _firsts(pairs)
            n = np.diff(np.append(first, len(pairs)))
            chunk, at = pairs[first] // len(rows), rows[pairs[first] % len(rows)]
            key, row = np.unique(chunk * len(langs.dictionary) + lang[at], return_inverse=True)
            parts.append(Part(
                chunks.dictionary.cast(pa.binary()).take(pa.array(key // len(langs.dictionary))),
                langs.dictionary.take(pa.array(key % len(langs.dictionary))), (row, source[at], n), (row, doc[at]),
            ))
            if sum(len(p.count[0]) for p in parts) >= held:
                parts = [Part.joined(parts, least)]
                if len(parts[0].count[0]) >= held // 2:
                    yield parts.pop().pack()
    if parts:
        yield Part.joined(parts, least).pack()


def _runs(batches: Iterator[pa.RecordBatch], least: int, held: int) -> Iterator[Part]:
    """Sorted rows joined by (lang, key). All rows of a key are in one part: the last key waits for the next batches."""
    parts, size = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(Part.unpack(batch))
            size += len(parts[-1].count[0]) + len(parts[-1].doc[0])
        if size >= held:
            part = Part.joined(parts, least)
            whole = int(np.searchsorted(_appearance(part.key), len(part.key.dictionary_encode().dictionary) - 1))
            done, last = part.split(whole)
            if len(done):
                yield done
            parts, size = [last], 0
    if parts:
        yield Part.joined(parts, least)


def _appearance(key: pa.Array) -> np.ndarray:
    return key.dictionary_encode().indices.to_numpy()


def _terms_of(part: Part) -> Part:
    """The rows of a part's chunks as rows of their terms: each distinct chunk is read once, its terms join all its counts."""
    keys = part.key.dictionary_encode()
    cleaned = b"\n".join(keys.dictionary.to_pylist()).translate(FOLD).split(b"\n")
    found = [c.split() for c in cleaned]
    many = np.array([len(f) for f in found], np.int64)
    begin = np.cumsum(many) - many
    terms = pa.array([t for f in found for t in f], pa.binary())
    of = keys.indices.to_numpy()
    each = many[of]
    at = np.cumsum(each) - each

    def spread(row: np.ndarray, *columns: np.ndarray) -> tuple:
        times = each[row]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return (np.repeat(at[row], times) + inside, *(np.repeat(c, times) for c in columns))

    rows = np.repeat(np.arange(len(part)), each)
    which = begin[of[rows]] + np.arange(len(rows)) - at[rows]
    return Part(terms.take(pa.array(which)), part.lang.take(pa.array(rows)), spread(*part.count), spread(*part.doc))


def _join_terms(batches: Iterator[pa.RecordBatch], least: int, held: int) -> Iterator[pa.RecordBatch]:
    """From chunks, sorted, to terms."""
    parts: list[Part] = []
    for part in _runs(batches, least, max(1, held // 4)):
        parts.append(_terms_of(part))
        if sum(len(p.count[0]) for p in parts) >= held:
            parts = [Part.joined(parts, least)]
            if len(parts[0].count[0]) >= held // 2:
                yield parts.pop().pack()
    if parts:
        yield Part.joined(parts, least).pack()


def _keep_terms(batches: Iterator[pa.RecordBatch], least: int, held: int) -> Iterator[pa.RecordBatch]:
    """From terms, sorted: those in enough documents, with their occurrences by source."""
    for part in _runs(batches, least, max(1, held // 4)):
        row, source, n = part.count
        ok = (np.bincount(part.doc[0], minlength=len(part)) >= least)[row]
        at = pa.array(row[ok])
        yield pa.RecordBatch.from_arrays([part.lang.take(at), part.key.take(at), pa.array(source[ok]), pa.array(n[ok])], ["lang", "term", "of", "n"])


def kept_terms(docs: DataFrame, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(lang, term, of, n): occurrences of the terms in at least ``least`` documents of the language, n above 0; ``of`` is
    the source's 64-bit hash."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), blank("lang").alias("lang"), F.xxhash64(blank("source")).alias("of"), blank("text").alias("text"))
    step = lambda df, f: df.mapInArrow(lambda batches: f(batches, least, held), COUNTED).repartition("key").sortWithinPartitions("key", "lang")
    terms = step(step(rows, _count_chunks), _join_terms)
    kept = terms.mapInArrow(lambda batches: _keep_terms(batches, least, held), KEPT)
    return kept.withColumn("term", F.col("term").cast("string"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p: 1 + floor(SCALE * (count + ADD) / (total + ADD * kept)), in whole numbers."""
    whole = lambda c: c.cast("decimal(22,0)")
    above, below = whole(count + ADD) * F.lit(SCALE), whole(total + kept * ADD)
    return F.call_function("div", above, below).cast("long") + 1


_PAIRS = "lang string, i int, j int, value long"


def _compare(key: tuple, rows: pa.Table, sources: pa.Table, block: int) -> pa.Table:
    """Sums of |p - q| over one part of the terms, for each source of one block and each of another."""
    lang, _, lo, hi = (k.as_py() for k in key)
    at = sources.column("at").to_numpy()
    order = np.argsort(at)
    at, rest = at[order], sources.column("p0").to_numpy()[order]
    in_all = sources.column("terms")[0].as_py()
    term = rows.column("term").combine_chunks().dictionary_encode()
    many = len(term.dictionary)
    p = np.tile(rest, (many, 1))
    p[term.indices.to_numpy(), np.searchsorted(at, rows.column("at").to_numpy())] = rows.column("p").to_numpy()
    mine, theirs = np.flatnonzero(at // block == lo), np.flatnonzero(at // block == hi)
    out = []
    for i in mine:
        value = np.abs(p[:, theirs] - p[:, [i]]).sum(axis=0) + (in_all - many) * np.abs(rest[theirs] - rest[i])
        out.append((np.full(len(theirs), at[i]), at[theirs], value))
        if lo != hi:
            out.append((at[theirs], np.full(len(theirs), at[i]), value))
    i, j, value = (np.concatenate(c) for c in zip(*out))
    other = i != j
    i, j, value = i[other], j[other], value[other]
    return pa.table([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.int64())], names=["lang", "i", "j", "value"])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, held: int = HELD, block: int = BLOCK, terms_at_once: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of each language are apart, and by which terms.

    ``docs`` has text, lang, source; null is empty in each, further columns are dropped. A term is a run of letters (A to Z
    lower-cased) and of characters beyond ASCII; a language keeps those in at least ``least`` of its rows (repeated rows
    count repeatedly). p and q are ``share``s. Part ``pair`` has each other source of the language, with the sum of
    |p - q| over all kept terms (0 if there are none); part ``term`` the ``top`` terms that a source has more of than its
    language, with p - q. Ranks start at 1, by value descending, ties by item in UTF-8 order. An empty table gives an
    empty result. Sources of a language are compared in blocks of terms and sources; the pairs are the result itself.
    """
    c = F.col
    kept = materialise(kept_terms(docs, least, held), "kept-terms")
    by_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = by_lang.groupBy(c("lang").alias("l")).agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy(c("lang").alias("tl"), c("of").alias("ts")).agg(F.sum("n").alias("total"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct().withColumn("of", F.xxhash64("source"))
    groups = groups.join(langs, c("lang") == c("l"), "left").join(totals, (c("lang") == c("tl")) & (c("of") == c("ts")), "left")
    groups = groups.select("lang", "source", "of", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("v", "lang_total", "total")])
    here = W.partitionBy("lang")
    groups = groups.withColumn("at", (F.row_number().over(here.orderBy("source")) - 1).cast("int")).withColumn("many", F.count(F.lit(1)).over(here))
    groups = materialise(groups, "groups")

    rows = kept.join(groups, ["lang", "of"]).withColumn("p", share(c("n"), c("total"), c("v")))
    parts = F.ceil(c("v") / terms_at_once).cast("long")
    part = F.pmod(F.xxhash64("term"), parts)
    blocks = F.explode(F.sequence(F.lit(0), F.ceil(c("many") / block).cast("int") - 1)).alias("other")
    own = F.floor(c("at") / block).cast("int")
    ends = (F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"))
    cells = rows.select("lang", part.alias("part"), "at", "term", "p", blocks).select("lang", "part", *ends, "at", "term", "p")
    sizes = by_lang.join(langs, c("lang") == c("l")).groupBy(c("lang").alias("sl"), part.alias("sp")).agg(F.count(F.lit(1)).alias("terms"))
    ground = groups.filter("v > 0").withColumn("p0", share(F.lit(0), c("total"), c("v"))).join(sizes, c("lang") == c("sl"))
    ground = ground.select(c("lang").alias("lang"), c("sp").alias("part"), c("at").alias("at"), "p0", "terms", blocks).select("lang", "part", *ends, "at", "p0", "terms")
    keys = ("lang", "part", "lo", "hi")
    compared = cells.groupBy(*keys).cogroup(ground.groupBy(*keys)).applyInArrow(lambda key, a, b: _compare(key, a, b, block), _PAIRS)
    sums = compared.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))

    one = groups.select("lang", "source", c("at").alias("i"))
    other = groups.select("lang", c("source").alias("item"), c("at").alias("j"))
    pairs = one.join(other, "lang").filter("i <> j").join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = rows.join(by_lang, ["lang", "term"]).withColumn("more", c("p") - share(c("lang_n"), c("lang_total"), c("v")))
    terms = terms.filter("more > 0").select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), c("more").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(c("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(c("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, v.v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g JOIN v ON g.lang = v.lang),
gp AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
  1 + CAST(1000000000 * (coalesce(c.n, 0) + 5) AS HUGEINT) // CAST(gn.total + 5 * gn.v AS HUGEINT) AS p
  FROM gn JOIN k ON gn.lang = k.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
lp AS (SELECT c.lang, c.term, 1 + CAST(1000000000 * (sum(c.n) + 5) AS HUGEINT) // CAST(any_value(ln.total) + 5 * any_value(v.v) AS HUGEINT) AS q
  FROM c JOIN ln ON c.lang = ln.lang JOIN v ON c.lang = v.lang GROUP BY c.lang, c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term
  AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b
  ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, CAST(gp.p - lp.q AS BIGINT) AS value FROM gp
  JOIN lp ON gp.lang = lp.lang AND gp.term = lp.term WHERE gp.n > 0 AND gp.p > lp.q),
a AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
