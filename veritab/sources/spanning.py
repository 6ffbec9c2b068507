"""Records that span lines, read by many tasks: CSV cells with line breaks, JSON arrays.

Spark splits a file into byte ranges and each range into pieces at a separator. Whether a piece ends a record depends on
what stands before it: is a quote open, how many brackets are? A first pass works out, for every range, what it does to that
state, for either way it may begin; one row per range. Combined over the ranges of a file that gives the state in which each
range begins. A second pass cuts every range into records by itself; a record that crosses ranges comes in fragments, and
only those are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import materialise

# --- formats -----------------------------------------------------------------


def csv_after(line: str, quoted: bool) -> tuple[bool, int]:
    """Is a quoted cell open after the line? Quotes open a cell at its start only; two in a row are one inside."""
    at = 1 if line.startswith("\ufeff") else 0
    while True:
        if quoted:
            end = line.find('"', at)
            if end < 0:
                return True, 0
            if line.startswith('"', end + 1):
                at = end + 2
                continue
            quoted, at = False, end + 1
        elif line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False, 0
        at = comma + 1


STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)


def json_after(piece: str, quoted: bool) -> tuple[bool, int]:
    """Is a string open after the piece, and how many brackets more are."""
    if quoted:
        rest = REST_OF_STRING.match(piece)
        if not rest:
            return True, 0
        piece = piece[rest.end() :]
    if '"' in piece:
        piece = STRING.sub("", piece)
    left = piece.partition('"')
    opened = sum(map(left[0].count, "{[")) - sum(map(left[0].count, "}]"))
    return bool(left[1]), opened


@dataclass(frozen=True)
class Format:
    """``separator`` ends pieces; ``after`` tells whether a quote is open after a piece and how many brackets more."""

    separator: str
    after: Callable[[str, bool], tuple[bool, int]]


CSV = Format("\n", csv_after)
JSON = Format("}", json_after)
FORMATS = {"csv": CSV, "json": JSON}

# --- ranges ------------------------------------------------------------------


def pieces(spark: SparkSession, path, kind: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, start, value) of every piece, in order within each range."""
    value = F.col("value")
    if encoding != "UTF-8":
        value = F.decode(value.cast("binary"), encoding)
    lines = spark.read.text(path, lineSep=FORMATS[kind].separator)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Neighbouring rows of the same range."""
    for batch in batches:
        file, start = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        values, extra = batch.column("value").to_pylist(), [batch.column(c).to_pylist() for c in batch.schema.names[3:]]
        lo = 0
        for hi in range(1, len(file) + 1):
            if hi == len(file) or start[hi] != start[lo] or file[hi] != file[lo]:
                yield (file[lo], start[lo], *(e[lo] for e in extra)), values[lo:hi]
                lo = hi


EFFECT = "file string, start long, out_quoted boolean, out_opened long, in_quoted boolean, in_opened long, first string"


def _effects(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """What each range does to a state that begins outside and inside of quotes."""
    separator, after = FORMATS[kind].separator, FORMATS[kind].after
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in EFFECT.split(", ")])
    at, row = None, None
    for key, values in _ranges(batches):
        if key != at:
            if row:
                yield pa.RecordBatch.from_pylist([row], schema)
            row = dict(file=key[0], start=key[1], out_quoted=False, out_opened=0, in_quoted=True, in_opened=0, first="")
            at = key
        for value in values:
            row["first"] = row["first"] or value.strip()[:1]
            piece = value + separator
            for way in ("out", "in"):
                # a piece without quotes changes nothing inside of them
                if row[f"{way}_quoted"] and '"' not in piece:
                    continue
                row[f"{way}_quoted"], opened = after(piece, row[f"{way}_quoted"])
                row[f"{way}_opened"] += opened
    if row:
        yield pa.RecordBatch.from_pylist([row], schema)


def states(effects: DataFrame) -> DataFrame:
    """(f, s, quoted, depth, base): the state in which each range begins, and the depth at which records of the file end.

    A range either sets the state, keeps it, or turns it around: the last one that set it and the turns since then tell.
    """
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    turns = (c("out_quoted") & ~c("in_quoted")).cast("int")
    rows = effects.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("set", F.when(c("out_quoted") == c("in_quoted"), F.struct(c("out_quoted").cast("int").alias("to"), "turned")))
    last = F.last("set", ignorenulls=True).over(before)
    turned = F.coalesce(F.lag("turned").over(order), F.lit(0))
    quoted = (F.coalesce(last["to"], F.lit(0)) + turned - F.coalesce(last["turned"], F.lit(0))) % 2 == 1
    rows = rows.withColumn("quoted", quoted).withColumn("opened", F.when(c("quoted"), c("in_opened")).otherwise(c("out_opened")))
    base = F.first(F.when(c("first").isin("[", "﻿["), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(c("file").alias("f"), c("start").alias("s"), "quoted", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("depth"), base.alias("base"))


PART = "file string, start long, first boolean, begins boolean, ends boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The records of each range, and fragments of those that begin before it or end after it.

    ``begins`` and ``ends`` tell what is there of a record; ``first`` marks a file's first record.
    """
    separator, after = FORMATS[kind].separator, FORMATS[kind].after
    names = [c.split()[0] for c in PART.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    out: list[tuple] = []
    at, held, begins, first, quoted, depth, base = None, [], True, False, False, 0, 0

    def batch():
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        out.clear()
        return done

    def left_over():
        if held:
            out.append((at[0], at[1], first, begins, False, separator.join(held) + separator))

    for key, values in _ranges(batches):
        if key[:2] != at:
            left_over()
            at, (quoted, depth, base) = key[:2], key[2:]
            held, begins, first = [], not quoted and depth <= base, key[1] == 0
        for value in values:
            held.append(value)
            if quoted and '"' not in value:
                continue
            quoted, opened = after(value + separator, quoted)
            depth += opened
            if not quoted and depth <= base:
                out.append((*at, first, begins, True, separator.join(held) + separator))
                held, begins, first = [], True, False
        if len(out) >= 4096:
            yield batch()
    left_over()
    if out:
        yield batch()


def records(spark: SparkSession, path, kind: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, first, text) of every record of the files; ``first`` marks a file's first record.

    The records are written once, as later passes would cut them again. Ranges are those of Spark's file splits; should
    they change between the passes, reading fails rather than guess.
    """
    parts = pieces(spark, path, kind, encoding)
    known = states(parts.mapInArrow(lambda batches: _effects(batches, kind), EFFECT))
    c = F.col
    # in order, one small row per range (a millionth of the input) looked up where the pieces are: nothing is shuffled
    parts = parts.join(F.broadcast(known), (c("file") == c("f")) & (c("start") == c("s")), "left")
    sure = F.when(c("f").isNull(), F.raise_error(F.lit("the input's splits changed while it was read")).cast("boolean")).otherwise(c("quoted"))
    parts = parts.select("file", "start", "value", sure.alias("quoted"), "depth", "base")
    return joined(materialise(parts.mapInArrow(lambda batches: _cut(batches, kind), PART), "records"))


def joined(cut: DataFrame) -> DataFrame:
    """Whole records as they are; fragments in order, each with the fragment of its file that begins its record."""
    c = F.col
    whole = cut.filter("begins AND ends").select("file", "first", "text")
    fragments = cut.filter("NOT (begins AND ends)")
    upto = Window.partitionBy("file").orderBy("start", c("begins").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    origin = F.last(F.when(c("begins"), c("start")), ignorenulls=True).over(upto)
    fragments = fragments.withColumn("origin", origin).groupBy("file", "origin").agg(
        F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text")
    )
    return whole.unionByName(fragments.select("file", "first", "text"))
