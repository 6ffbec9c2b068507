"""Column expressions shared by every operator. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# --- fixed values -----------------------------------------------------------
# Characters Python's str.strip() removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
EMAIL = r"(?U)^[\w\.-]+@[\w\.-]+\.[a-zA-Z]{2,}$"
TRUE_WORDS = ("true", "yes", "y", "t", "1", "1.0")
FALSE_WORDS = ("false", "no", "n", "f", "0", "0.0")
BOOLEAN_PAIRS = (("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"), ("1.0", "0.0"), ("t", "f"))
DATE_LOOKS = (
    r"^\s*\d{4}[-/]\d{2}[-/]\d{2}",
    r"^\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"^\s*[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}",
    r"^\s*\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}",
)
# ----------------------------------------------------------------------------


def kind_of(data_type: T.DataType) -> str:
    """number / boolean / text / temporal / mixed / other, from the Spark type alone."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(data_type, T.VariantType):
        return "mixed"
    return "other"


def quoted(name: str) -> Column:
    """Column reference that survives dots, blanks and backticks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Like Python's str.strip(). A text that begins and ends with a visible ASCII character is left as it is, which costs
    a fraction of seeking its ends among all blanks."""
    plain = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(BLANKS)))


def to_number(c: Column) -> Column:
    """Strict text to double: plain or scientific notation only, anything else is NULL."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def without_symbols(c: Column) -> Column:
    return strip(F.translate(c, ",$%", ""))


def to_number_loose(c: Column) -> Column:
    """Like ``to_number`` after dropping thousands separators, dollar and percent signs."""
    return to_number(without_symbols(c))


def numeric_value(c: Column, kind: str) -> Column | None:
    """The double the statistics work on, or None where a column can never be numeric."""
    if kind == "number":
        return c.cast("double")
    if kind == "text":
        return to_number(c)
    return None


def to_boolean(c: Column, kind: str) -> Column:
    """True/false words, digits and booleans to BOOLEAN; other values become NULL."""
    if kind == "boolean":
        return c
    if kind == "number":
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def boolean_pair(c: Column) -> Column:
    """Which true/false spelling a text value belongs to (NULL when none)."""
    word = F.lower(strip(c))
    out = F.when(F.lit(False), F.lit(0))
    for i, pair in enumerate(BOOLEAN_PAIRS):
        out = out.when(word.isin(*pair), F.lit(i))
    return out


def looks_like_date(c: Column) -> Column:
    hit = c.rlike(DATE_LOOKS[0])
    for pattern in DATE_LOOKS[1:]:
        hit = hit | c.rlike(pattern)
    return hit


def readings(df: DataFrame, value: str) -> DataFrame:
    """Adds number, loose, pair, date, plain, bytes and chars of a text: ``to_number``, ``to_number_loose``,
    ``boolean_pair``, ``looks_like_date``, PLAIN_NUMBER and the two lengths.

    Patterns are only tried where the first visible character allows them, and the stripped text is made once.
    """
    c, text, bare, first, bare_first = (F.col(x) for x in (value, "__text", "__bare", "__first", "__bare_first"))
    signs = F.contains(c, F.lit(",")) | F.contains(c, F.lit("$")) | F.contains(c, F.lit("%"))
    # octets: no character beyond ASCII has a word's letter as its lower case
    longest = max(len(w) for words in BOOLEAN_PAIRS for w in words)
    df = df.withColumns({"__text": strip(c)})
    df = df.withColumns({"__bare": F.when(signs, without_symbols(c)).otherwise(text), "__first": F.ascii(text)})
    df = df.withColumns({"__bare_first": F.ascii(bare), "__word": F.when(F.octet_length(text) <= longest, F.lower(text))})

    def may_be_number(x: Column) -> Column:  # + - . or a digit
        return x.isin(43, 45, 46) | x.between(48, 57)

    spelled = F.when(F.lit(False), F.lit(0))
    for i, words in enumerate(BOOLEAN_PAIRS):
        spelled = spelled.when(F.col("__word").isin(*words), F.lit(i))
    dated = first.between(48, 57) | ((first.between(65, 90) | first.between(97, 122)) & F.contains(c, F.lit(",")))
    return df.withColumns(
        {
            "number": F.when(may_be_number(first) & c.rlike(NUMBER), c.try_cast("double")),
            "loose": F.when(may_be_number(bare_first) & bare.rlike(NUMBER), bare.try_cast("double")),
            "pair": F.when(F.col("__word").isNotNull(), spelled),
            "date": dated & c.rlike("|".join(f"(?:{p})" for p in DATE_LOOKS)),
            "plain": may_be_number(first) & c.rlike(PLAIN_NUMBER),
            "bytes": F.octet_length(c),
            "chars": F.char_length(c),
        }
    ).drop("__text", "__bare", "__first", "__bare_first", "__word")


def contains_any(c: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def instant(c: Column, type_name: str) -> Column:
    """Whole number that keeps the values of a temporal column apart: days or microseconds, free of time zones."""
    if type_name == "date":
        return F.unix_date(c)
    if type_name == "timestamp":
        return F.unix_micros(c)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + (seconds * 1_000_000).cast("long")


def literal_map(mapping: dict) -> Column:
    parts = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*parts)
