"""Text guards and repairs as column expressions: no shuffle, whole values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .exprs import strip

# --- fixed values -----------------------------------------------------------
SCRIPT = r"(?is)<script.*?>.*?</script>"
SQL_TOKENS = r"(?i)('|(--)|(/\*)|(\*/)|(\bSELECT\b)|(\bDROP\b)|(\bINSERT\b)|(\bUPDATE\b)|(\bDELETE\b))"
INJECTIONS = (
    "ignore previous instructions",
    "disregard all",
    "forget everything",
    "new instructions",
    "system prompt",
)
REDACTED = "[REDACTED]"
TRUNCATED = "... (truncated)"
MAX_ITEMS = 100
TABLE_LINES, TABLE_COMMAS = 3, 2
JSON_RECORD = r'\{\s*".*?"\s*:'
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
EMPTY_RESPONSE = (
    "I apologize, but I received an empty response. Please let me know how I can assist you with your dataset."
)
REPEATED_FROM = 40
# ----------------------------------------------------------------------------


def _cut(c: Column, max_chars: int | None) -> Column:
    return c if max_chars is None else F.substring(c, 1, max_chars)


def clean_prompt(c: Column, max_chars: int | None = None) -> Column:
    """Drop script blocks, escape angle brackets, strip; cut only if asked to. NULL becomes ''."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), SCRIPT, "")
    return strip(_cut(F.replace(F.replace(plain, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), max_chars))


def clean_user_input(c: Column, max_chars: int | None = None) -> Column:
    """Drop quote marks, comment marks and SQL verbs, strip; cut only if asked to."""
    return strip(_cut(F.regexp_replace(c, SQL_TOKENS, ""), max_chars))


def redact_injections(c: Column, max_chars: int | None = None) -> Column:
    """Replace known injection phrases; if asked to, over-long content is then cut and marked."""
    out = c
    for phrase in INJECTIONS:
        out = F.regexp_replace(out, "(?i)" + phrase, REDACTED)
    if max_chars is None:
        return out
    return F.when(F.char_length(out) > max_chars, F.concat(F.substring(out, 1, max_chars), F.lit(TRUNCATED))).otherwise(out)


def looks_tabular(c: Column) -> Column:
    """Three or more filled lines of which each of the first five has at least two commas."""
    lines = F.filter(F.transform(F.split(c, LINE_BREAK, -1), strip), lambda x: x != "")
    first = F.slice(lines, 1, 5)
    return (F.size(lines) >= TABLE_LINES) & F.forall(
        first, lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit(""))) >= TABLE_COMMAS
    )


def looks_like_records(c: Column) -> Column:
    whole = strip(c)
    return F.startswith(whole, F.lit("[")) & F.endswith(whole, F.lit("]")) & whole.rlike(JSON_RECORD)


def looks_like_frame(c: Column) -> Column:
    """A JSON object with ``columns`` and a ``data`` list."""
    return F.get_json_object(c, "$.columns").isNotNull() & F.coalesce(
        F.startswith(F.get_json_object(c, "$.data"), F.lit("[")), F.lit(False)
    )


def payload_problems(c: Column, max_chars: int | None = None) -> Column:
    """All reasons to hold a text back: oversized (if a size is given), tabular, records, frame. Empty when it may pass."""
    found = [F.when(F.char_length(c) > max_chars, F.lit("oversized"))] if max_chars is not None else []
    found += [
        F.when(test(c), F.lit(name)) for test, name in ((looks_tabular, "tabular"), (looks_like_records, "records"), (looks_like_frame, "frame"))
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def too_many_items(c: Column, most: int = MAX_ITEMS) -> Column:
    """For array and map columns."""
    return F.size(c) > most


def repair_response(c: Column) -> Column:
    """Markdown repairs: heading blanks, repeated paragraphs, open code fence, unclosed table rows."""
    text = F.regexp_replace(c, r"(?md)^(#{1,6})([^#\s])", "$1 $2")
    text = _drop_repeats(text)
    fences = (F.char_length(text) - F.char_length(F.replace(text, F.lit("```"), F.lit("")))) / 3
    text = F.when(fences % 2 != 0, F.concat(text, F.lit("\n```\n"))).otherwise(text)
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda line: F.when(
            F.startswith(strip(line), F.lit("|")) & ~F.endswith(strip(line), F.lit("|")), F.concat(line, F.lit(" |"))
        ).otherwise(line),
    )
    repaired = F.array_join(lines, "\n")
    return F.when(c.isNull() | (strip(c) == ""), F.lit(EMPTY_RESPONSE)).otherwise(repaired)


def _drop_repeats(text: Column) -> Column:
    """Keep the first of equal long paragraphs, compared without case and with blanks folded."""
    parts = F.transform(
        F.split(text, "\n\n", -1),
        lambda p: F.struct(
            p.alias("text"),
            F.when(F.char_length(strip(p)) > REPEATED_FROM, F.xxhash64(F.lower(F.regexp_replace(strip(p), r"(?U)\s+", " ")))).alias("key"),
        ),
    )
    # The one-element array binds paragraphs and keys, so that the filter looks keys up instead of making them again.
    bound = F.array(F.struct(parts.alias("parts"), F.transform(parts, lambda p: p["key"]).alias("keys")))
    kept = F.transform(
        bound, lambda b: F.filter(b["parts"], lambda p, i: p["key"].isNull() | (F.array_position(b["keys"], p["key"]) == i + 1))
    )
    return F.array_join(F.transform(F.get(kept, F.lit(0)), lambda p: p["text"]), "\n\n")


def count_matches(c: Column, query: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """How often a phrase occurs."""
    return F.size(find_matches(c, query, case_sensitive, whole_word))


def find_matches(c: Column, query: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """The matched pieces of text, in order; an empty query matches nothing."""
    if not query:
        return F.array().cast("array<string>")
    quoted = "".join("\\" + ch if ch in r".*+?^${}()|[]\/-" else ch for ch in query)
    pattern = ("" if case_sensitive else "(?i)") + (rf"\b{quoted}\b" if whole_word else quoted)
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def contains_text(c: Column, query: str) -> Column:
    return F.contains(F.lower(c), F.lit(query.lower()))
