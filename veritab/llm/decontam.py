"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a stretch of words that ignores some positions, so a changed word there does not matter. Every
seed at every position of every text is joined with the seeds of the benchmark items. Around a hit the words of text and
item are compared position by position, and the overlap counts if enough of them agree in some stretch that holds the hit:
substitutions are tolerated anywhere. The comparison runs where the hit is found, on the text's own words, so no text travels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import content_key, materialise, quoted, words

# With 80 % of its words equal, a stretch of 6 words or more has three in a row, and one of 5 has them or only its middle word
# changed. The masks of span 7 are the ones that the SQL has; items of one and two words have masks of their own.
MASKS = ("1101011", "1011011", "11011", "111")
WINDOW = 24  # words compared at most; an item with fewer is compared whole
RUN = 13  # words compared at least, in items that have more
LEAST = 0.8  # share of them that must agree
BROADCAST_BYTES = 64_000_000  # of benchmark seeds with their stretch of words; beyond, seeds are joined by shuffling
BIT_WORDS = 1 << 18  # of 64 bits: at most so many rows are broadcast, however many keys there are


def word_hashes(text):
    return F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))


def seeds(w, at, masks=MASKS):
    """One hash per mask over the words it picks from this place on, null without room; the mask is part of the hash."""
    hashed = lambda m: F.xxhash64(F.lit(m), *[F.get(w, at + i) for i, bit in enumerate(m) if bit == "1"])
    return F.array(*[F.when(at + len(m) <= F.size(w), hashed(m)) for m in masks])


def seeded(rows: DataFrame, w: str, at: str, seed: str, masks=MASKS) -> DataFrame:
    """``rows`` once for each place of the words ``w`` that has room for a mask and each mask.

    A row without room stays once with a null seed, which joins with nothing: for a plain explode the optimizer would
    compute the words once more to filter such rows.
    """
    span = min(map(len, masks))
    places = F.when(F.size(w) >= span, F.sequence(F.lit(0), F.size(w) - span))
    rows = rows.select("*", F.explode_outer(places).alias(at))
    return rows.select("*", F.explode_outer(F.when(F.col(at).isNotNull(), seeds(F.col(w), F.col(at), masks))).alias(seed))


def _item_seeds(items: DataFrame, masks, window: int) -> tuple[DataFrame, tuple[str, ...]]:
    """(item, row, item_seed, at, lo, width, stretch): each seed with the words of its item that can share a stretch with
    it, and the masks in use. ``row`` tells items of equal id apart by their words."""
    v = items.select(F.col("item_id").alias("item"), word_hashes(F.col("text")).alias("v"))
    s = seeded(v.filter(F.size("v") > 2), "v", "at", "item_seed", masks)
    for r in v.filter(F.size("v").isin(1, 2)).select(F.size("v").alias("n")).distinct().collect():
        s = s.union(seeded(v.filter(F.size("v") == r.n), "v", "at", "item_seed", ("1" * r.n,)))
        masks = (*masks, "1" * r.n)
    n = F.size("v")
    width = F.least(n, F.lit(window))
    lo, hi = F.greatest(F.lit(0), F.col("at") - width + 1), F.least(n, F.col("at") + width)
    s = s.filter("item_seed IS NOT NULL").withColumn("lo", lo)
    return s.select("item", F.xxhash64("v").alias("row"), "item_seed", "at", "lo", width.alias("width"), F.slice("v", F.col("lo") + 1, hi - F.col("lo")).alias("stretch")), masks


def overlaps(docs: DataFrame, items: DataFrame, masks=MASKS, window: int = WINDOW, least: float = LEAST, run: int = RUN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, item, start, compared, equal): the longest stretch around each hit that passes, and its equal words.

    Of equally long stretches the one with most equal words counts, then the last. Words are compared by their 64-bit
    hashes. Seeds meet by broadcast while the items' seeds are few bytes; beyond, narrow seeds are shuffled and only texts
    with a hit are looked up again.
    """
    s, masks = _item_seeds(items, masks, window)
    s = materialise(s, "item-seeds")
    size = s.agg(F.coalesce(F.sum(F.size("stretch") * 8 + 64), F.lit(0))).first()[0]
    rows = docs.select(content_key("doc_id", "text").alias("key"), word_hashes(F.col("text")).alias("w"))
    from_text = F.col("pos") - F.col("at") + F.col("lo")
    if size <= broadcast_bytes:
        hit = seeded(rows, "w", "pos", "seed", masks).join(F.broadcast(s), F.col("seed") == F.col("item_seed"))
    else:
        # the same few columns on both sides, one row per alignment, then the words of the texts that have one
        met = seeded(rows, "w", "pos", "seed", masks).select("key", "pos", "seed").join(s.select("item", "row", "item_seed", "at", "lo"), F.col("seed") == F.col("item_seed"))
        met = met.select("item", "row", "lo", F.col("key").alias("k"), (F.col("pos") - F.col("at")).alias("shift")).distinct()
        full = s.groupBy(F.col("item").alias("i"), F.col("row").alias("r"), F.col("lo").alias("l")).agg(F.min("at").alias("at"), F.first("width").alias("width"), F.max_by("stretch", F.size("stretch")).alias("stretch"))
        met = met.join(full, F.col("item").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")) & (F.col("lo") == F.col("l")))
        hit = rows.join(met, F.col("key") == F.col("k")).withColumn("pos", F.col("shift") + F.col("at"))
    # compared in the aggregate, so that the comparison is not drawn into the join and the join stays compiled
    there = lambda x, i: (from_text + i >= 0) & F.coalesce(F.get("w", from_text + i) == x, F.lit(False))
    same = F.transform("stretch", lambda x, i: there(x, i).cast("int"))
    hit = hit.groupBy("key", "item", "row", (F.col("pos") - F.col("at")).alias("shift"), "lo", "width").agg(F.max(same).alias("same"))
    total = F.aggregate("same", F.lit(0), lambda a, b: a + b)
    shortest = F.least(F.lit(run), F.col("width"))
    hit = hit.filter(total >= F.ceil(shortest * least))
    # running sums in one fold, written before they are read many times: an expression would be made anew for each reading
    upto = F.aggregate("same", F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))
    hit = materialise(hit.select("key", "item", (F.col("shift") + F.col("lo")).alias("from"), "width", upto.alias("upto")), "hits")
    hit = hit.select("*", F.explode(F.sequence(F.least(F.lit(run), F.col("width")), "width")).alias("compared"))
    equal = F.transform(F.sequence(F.lit(0), F.size("upto") - 1 - F.col("compared")), lambda a: F.struct((F.get("upto", a + F.col("compared")) - F.get("upto", a)).alias("equal"), (F.col("from") + a).alias("start")))
    hit = hit.select("key", "item", "compared", F.array_max(equal).alias("best")).filter(F.col("best.equal") >= F.ceil(F.col("compared") * least))
    best = hit.groupBy("key", "item").agg(F.max(F.struct("compared", "best")).alias("b"))
    return best.select("key", "item", "b.best.start", "b.compared", "b.best.equal")


ADDED = ("contaminated", "n_items", "item_id", "overlap")


def scan(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] | None = None, **how) -> DataFrame:
    """``docs`` (or its columns ``keep``) with contaminated, n_items, item_id and overlap.

    ``items`` has item_id and text. A text is contaminated if some stretch of ``run`` to ``window`` words of an item (the
    whole item if shorter) agrees with it in at least ``least`` of its words. ``n_items`` counts such items, ``item_id`` is
    the one with the largest overlap (ties: the smallest id). The overlap of an item is the share of equal words in the
    longest stretch that passes, so a verbatim quote with other words around it may have less than 1: 13 quoted words
    make a stretch of 16 with 13 equal. Words compare without case. Null and empty texts are clean. The masks find all
    stretches at 80 % or more. Repeated rows each get the full result. Columns of ``docs`` with one of these names are
    replaced; any other name is kept. ``how`` goes to ``overlaps``.
    """
    keep = [c for c in docs.columns if c not in ADDED] if keep is None else list(keep)
    found = overlaps(docs, items, **how)
    best = found.select("key", "item", (F.col("equal") / F.col("compared")).alias("overlap")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max("overlap").alias("overlap"),
        F.min_by("item", F.struct((-F.col("overlap")).alias("o"), "item")).alias("first"),
    )
    rows = docs.select(F.struct(*[quoted(c) for c in keep]).alias("kept"), content_key("doc_id", "text").alias("of"))
    rows = rows.join(best, F.col("of") == F.col("key"), "left")
    return rows.select(
        "kept.*",
        F.col("key").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("first").alias("item_id"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"),
    )


def _word(key):
    return F.shiftrightunsigned(key["a"], 6).bitwiseAND(F.lit(BIT_WORDS - 1).cast("long"))


def _bit(key):
    return F.call_function("shiftleft", F.lit(1).cast("long"), key["a"].bitwiseAND(F.lit(63).cast("long")).cast("int"))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged.

    Only rows that may be contaminated travel: a table of bits says which keys cannot be among those found, and rows with
    such keys stay where they are, whatever the share of contaminated ones.
    """
    c = F.col
    found = materialise(overlaps(docs, items, **how).select("key").distinct(), "contaminated")
    bits = F.broadcast(found.groupBy(_word(c("key")).alias("_word")).agg(F.bit_or(_bit(c("key"))).alias("_bits")))
    rows = docs.select(F.struct(*[quoted(x) for x in docs.columns]).alias("all"), content_key("doc_id", "text").alias("of"))
    rows = rows.join(bits, _word(c("of")) == c("_word"), "left")
    may_be = F.coalesce(c("_bits").bitwiseAND(_bit(c("of"))) != 0, F.lit(False))
    cleared = rows.filter(may_be).join(found, c("of") == c("key"), "left_anti")
    return rows.filter(~may_be).select("all.*").unionAll(cleared.select("all.*"))


# Brute force: every alignment of every text with every item, every stretch of it.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS item, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS v FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
bw AS (SELECT item, len(v) AS n, unnest(v) AS word, unnest(range(0, len(v))) AS i FROM b),
a AS (SELECT doc_id, item, n, p - i AS shift, list(i) AS same FROM dw JOIN bw USING (word) GROUP BY doc_id, item, n, p - i
  HAVING count(*) >= ceil(least(n, 13) * 0.8)),
k AS (SELECT *, unnest(range(least(n, 13), least(n, 24) + 1)) AS compared FROM a),
s AS (SELECT *, unnest(range(0, n - compared + 1)) AS lo FROM k),
e AS (SELECT doc_id, item, compared, len(list_filter(same, lambda x: x >= lo AND x < lo + compared)) AS equal FROM s),
l AS (SELECT doc_id, item, max(compared) AS longest FROM e WHERE equal >= ceil(compared * 0.8) GROUP BY doc_id, item),
m AS (SELECT e.doc_id, e.item, max(e.equal / e.compared) AS overlap FROM e JOIN l ON e.doc_id = l.doc_id AND e.item = l.item AND e.compared = l.longest
  WHERE e.equal >= ceil(e.compared * 0.8) GROUP BY e.doc_id, e.item),
r AS (SELECT doc_id, count(*) AS n_items, max(overlap) AS overlap, arg_min(item, (-overlap, item)) AS item_id FROM m GROUP BY doc_id)
SELECT d.doc_id, r.doc_id IS NOT NULL AS contaminated, coalesce(r.n_items, 0) AS n_items, r.item_id, coalesce(r.overlap, 0.0) AS overlap
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
