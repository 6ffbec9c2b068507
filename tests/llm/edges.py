"""Rows that every operator has to stand: nulls in any column, empty and long texts, repeats, further columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label int"
PROSE = {
    "en": "the house by the river was old and the people who lived there were kind to every stranger that came along the road",
    "de": "das haus am fluss war alt und die leute die dort wohnten waren freundlich zu jedem fremden der die strasse entlang kam",
    "fr": "la maison au bord de la riviere etait vieille et les gens qui y vivaient etaient gentils avec chaque etranger de passage",
}


def rows():
    out = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        words = PROSE[lang].split()
        out.append((i, " ".join(words[i % 7 :] + words[: i % 7] + [f"w{i}"]), lang, f"s{i % 4}", 9, "x", "y", 1))
    long_text = " ".join(PROSE["en"].split()[(k * k + k // 3) % 20] + str(k % 17) for k in range(30_000))
    out += [
        (100, None, "en", "s0", None, None, None, None),
        (101, "", "en", "s1", 0, "x", None, 1),
        (102, " \t\n ", None, None, 4, None, "y", None),
        (103, "1234 5678 !!", "de", None, 12, None, None, None),
        (None, "the house by the river was old", "en", None, 30, "x", "y", 1),
        (None, None, None, None, None, None, None, None),
        (104, long_text, "en", "s2", len(long_text), "x", "y", 1),
        (105, "Twice the same row of words for all of them to see", "en", "s3", 50, "x", "y", 1),
        (105, "Twice the same row of words for all of them to see", "en", "s3", 50, "x", "y", 1),
        (106, "short one", "en", "s1", 9, "x", "y", 1),
    ]
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


CLASHES = ("key", "first", "kept", "_key", "_source", "_all", "ca", "cb", "of", "w", "seed", "n", "word", "lang_pred", "a.b")


def clashing(spark):
    """The same rows with columns named as the operators name theirs."""
    df = docs(spark)
    return df.select("*", *[F.lit(f"my {x}").alias(x) for x in CLASHES])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
