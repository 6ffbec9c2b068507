"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, its text alone is trainable. A
conversation's formatted turns are stored once, as pieces with their offset in the conversation; an example names its
context as the stretch from 0 to the target's offset. Written out, the examples of one conversation grow with the square
of its turns; as stretches they stay one row per turn. ``write_parts`` gives the texts of the examples, a row per turn.

A piece is ``<turn ROLE>TEXT</turn>``. In ROLE and TEXT the characters ``\\ < > #`` get a backslash in front, so no marker
or control string can come from a text, and taking backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import running_before

PIECE = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<>#])", r"\\$1")


def format_turns(conversations: DataFrame, trainable: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, start, piece, context_end, loss_start, loss_end.

    ``conversations`` has conv_id, turn, role, text; further columns are dropped. ``start`` is the piece's offset in the
    conversation, in characters. For a trainable turn the row is an example: context is the conversation's characters from
    0 to ``context_end`` (its own start), and the characters ``loss_start`` to ``loss_end`` of its piece are under the loss;
    other rows have nulls there. A null role or text is empty; a null turn goes first; equal (conv_id, turn) go by role,
    then text; repeated rows are repeated turns; rows of a null conv_id form one conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<turn "), escape(role), F.lit(">"))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.concat(head, escape(text), F.lit("</turn>")).alias("piece"),
        F.when(role.isin(*trainable), F.char_length(head)).cast("long").alias("loss_start"),
    )
    rows = rows.withColumn("chars", F.char_length("piece").cast("long"))
    rows = running_before(rows, "conv_id", ["turn", "role", "piece"], "chars", "start", "chat")
    return rows.select(
        "conv_id",
        "turn",
        "start",
        "piece",
        F.when(F.col("loss_start").isNotNull(), F.col("start")).alias("context_end"),
        "loss_start",
        F.when(F.col("loss_start").isNotNull(), F.col("chars") - len("</turn>")).alias("loss_end"),
    )


def write_parts(pieces: DataFrame) -> DataFrame:
    """The examples in full, a row for each turn in them: conv_id, example, part, turn, piece, loss_start, loss_end.

    ``example`` is the offset of the reply in its conversation, ``part`` that of the piece; an example's pieces in order of
    ``part`` are its text, the last of them the reply, which alone has a span under the loss. No example is held in one
    row or task, but the rows of a conversation grow with the square of its turns: that is what was asked for.
    """
    replies = pieces.filter("context_end IS NOT NULL").select(F.col("conv_id").alias("__conv"), F.col("context_end").alias("example"))
    pairs = pieces.join(replies, F.col("__conv").eqNullSafe(F.col("conv_id")) & (F.col("start") <= F.col("example")))
    is_reply = F.col("start") == F.col("example")
    spans = [F.when(is_reply, F.col(c)).alias(c) for c in ("loss_start", "loss_end")]
    return pairs.select("conv_id", "example", F.col("start").alias("part"), "turn", "piece", *spans)


def write_out(pieces: DataFrame) -> DataFrame:
    """The examples as one text each: conv_id, turn, context, target. Use where conversations are short, else ``write_parts``."""
    before = F.when(F.col("part") < F.col("example"), F.struct("part", "piece"))
    reply = F.max(F.when(F.col("part") == F.col("example"), F.struct("turn", "piece"))).alias("reply")
    whole = write_parts(pieces).groupBy("conv_id", "example").agg(F.array_sort(F.collect_list(before)).alias("before"), reply)
    context = F.array_join(F.transform("before", lambda x: x["piece"]), "").alias("context")
    return whole.select("conv_id", F.col("reply.turn").alias("turn"), context, F.col("reply.piece").alias("target"))


def expand(pieces: DataFrame) -> DataFrame:
    """The conversations' stored pieces and, beside them, the examples: conv_id, position, is_piece, piece, loss_start, loss_end.

    An example stands where its context ends: the context is the conversation's text from 0 to ``position``, ``piece`` is
    the reply that follows it, and only ``loss_start`` to ``loss_end`` of that is trainable. Nothing of a stored piece is.
    """
    none = F.lit(None).cast("long")
    stored = F.struct(F.col("start").alias("position"), F.lit(True).alias("is_piece"), "piece", none.alias("loss_start"), none.alias("loss_end"))
    example = F.struct(F.col("context_end").alias("position"), F.lit(False).alias("is_piece"), "piece", "loss_start", "loss_end")
    both = F.when(F.col("context_end").isNull(), F.array(stored)).otherwise(F.array(example, stored))
    return pieces.select("conv_id", F.inline(both))


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, n_examples long, contexts_sha256 string, loss_chars long, "
    "loss_sha256 string, formatted_chars long"
)


class _Reading:
    """What was read of one conversation: running hashes and lengths, never its texts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.n_turns = self.n_examples = self.loss_chars = self.chars = 0
        self.turns, self.contexts, self.loss = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

    def piece(self, piece: str) -> None:
        role, text = (ESCAPED.sub(r"\1", x) for x in PIECE.fullmatch(piece).groups())
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        self.chars += len(piece)

    def example(self, position: int, piece: str, lo: int, hi: int) -> None:
        """Its context is what has been read, if that ends where the context does; else it is torn, and gets no turns' hash."""
        self.n_examples += 1
        self.contexts.update(self.turns.hexdigest().encode() if position == self.chars else b"torn")
        trained = ESCAPED.sub(r"\1", piece[lo:hi])
        self.loss_chars += len(trained)
        self.loss.update(trained.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "n_examples": self.n_examples,
            "contexts_sha256": self.contexts.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation in order; only the running hashes of one conversation are held."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    reading, done = None, []
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("conv_id", "position", "is_piece", "piece", "loss_start", "loss_end"))
        for conv, position, is_piece, piece, lo, hi in zip(*cols):
            if reading is None or conv != reading.conv_id:
                if reading is not None:
                    done.append(reading.row())
                reading = _Reading(conv)
            if is_piece:
                reading.piece(piece)
            else:
                reading.example(position, piece, lo, hi)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if reading is not None:
        yield pa.RecordBatch.from_pylist([reading.row()], schema)


def read_back(expanded: DataFrame) -> DataFrame:
    """One row per conversation: hashes of its turns, of each example's context (a hash of its turns), of the trained text.

    A hash over a whole conversation is sequential, so its rows stream through one task in order; that task holds one
    batch and the running hashes, however long the conversation is. An example comes before the piece at its position.
    """
    return expanded.repartition("conv_id").sortWithinPartitions("conv_id", "position", "is_piece").mapInArrow(_digests, DIGEST)


def digest(pieces: DataFrame) -> DataFrame:
    return read_back(expand(pieces))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (SELECT *, coalesce(string_agg(role || chr(10) || text || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM t),
e AS (SELECT *, 14 + length(role || text) + length(regexp_replace(role || text, '[^\\<>#]', '', 'g')) AS chars FROM b)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples,
  sha256(coalesce(string_agg(sha256(context), '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS contexts_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
