import hashlib
import itertools
import random
import re

import pytest

from veritab.llm import decontam, language, licenses, mixing, neardup, pii

from .edges import CLASHES, clashing, docs, empty, rows

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, d[::-1]))) % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(CARD, t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_plain_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "1", "12", "300", "-", " ", "+", "(", ")", "_", "é", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.z", "10.0.0.1"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.find(t) == plain_spans(t), t


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail bob (at) example dot com now", "email", "bob (at) example dot com"),
        ("at jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
        ("joe at example dot co dot uk", "email", "joe at example dot co dot uk"),
        ("user[at]host.org, foo", "email", "user[at]host.org"),
        ("call plus four nine one five one two three four five six seven today", "phone", "plus four nine one five one two three four five six seven"),
        ("ring +49 １５１２ ３４５６７ now", "phone", "+49 １５１２ ３４５６７"),
        ("no four one one one, one one one one one one one one one one one one", "card", "four one one one, one one one one one one one one one one one one"),
        ("host 1９2.168.0.1 down", "ip", "1９2.168.0.1"),
        ("hidden a​nn@site​.org here", "email", "a​nn@site​.org"),
    ],
)
def test_disguises(text, kind, span):
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, pii.find(text))]
    assert (kind, span) in found


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("ruf plus vier neun eins fünf eins null fünf sechs sieben acht neun an", "phone", "plus vier neun eins fünf eins null fünf sechs sieben acht neun"),
        ("PLUS VIER NEUN EINS FÜNF EINS NULL FUENF SECHS SIEBEN ACHT NEUN", "phone", "PLUS VIER NEUN EINS FÜNF EINS NULL FUENF SECHS SIEBEN ACHT NEUN"),
        ("au plus trois trois six zéro un deux zero un cinq sept huit merci", "phone", "plus trois trois six zéro un deux zero un cinq sept huit"),
        ("plus vier neun eins fu\u0308nf null null fu\u0308nf eins zwei drei", "phone", "plus vier neun eins fu\u0308nf null null fu\u0308nf eins zwei drei"),
        ("call +1 555 one two 3456 78 now", "phone", "+1 555 one two 3456 78"),
        ("call plus four nine 151 2345678 now", "phone", "plus four nine 151 2345678"),
        ("plus 49 151 2345678", "phone", "plus 49 151 2345678"),
        ("+one (555) five 010-9999", "phone", "+one (555) five 010-9999"),
        ("card 4111 one one one one 1111 1111 on file", "card", "4111 one one one one 1111 1111"),
    ],
)
def test_spelled_digits(text, kind, span):
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, pii.find(text))]
    assert (kind, span) in found


@pytest.mark.parametrize("text", ["[" + "null, " * 15 + "null]", "un homme, 2 un peu plus 3 fois", "one 2 three plus four"])
def test_digit_words_alone(text):
    assert pii.disguised(text, pii.find(text)) == []


@pytest.mark.parametrize("text", ["look at the house. A dot com is no place", "one two three. Meet at four", "x > y < z (at noon)", "un deux trois quatre cinq", ""])
def test_prose_is_left_alone(text):
    assert pii.disguised(text, pii.find(text)) == []


@pytest.mark.parametrize(
    "text",
    [
        "Привет, как дела? Москва и Екатеринбург, в которых живут люди: пять книг, тысяча рублей.",
        "Καλημέρα κόσμε, τι κάνετε; Ζητώ βιβλία και χάρτες από την Αθήνα, μετά ρωτώ.",
        "Işık, İstanbul ve Diyarbakır'da nıne fıve ſix sıx seven: dokuz kişi kaldı, о kadar.",
        "ſix fıve nıne SİX one two three ſeven fıve",
    ],
)
def test_prose_of_other_scripts(text):
    assert pii.disguised(text, pii.find(text)) == []
    mail = f"{text} jоhn@exаmple.com {text}"
    at = len(text) + 1
    assert pii.disguised(mail, pii.find(mail)) == [(at, 0, at + 16)]


def test_rewrite_leaves_other_letters():
    assert pii.rewrite("вкмт βζηκ nıne ſix SEVEN о ｉ")[0] == "вкмт βζηκ nıne ſix 7 o i"


def test_scan_and_redact(spark):
    extra = [(200, "a@b.co and 10.0.0.1, +1 (555) 010-9999", "en", "s", 38, None, None, None), (201, "😀 c@d.org ann(at)e.org", "en", "s", 1, None, None, None)]
    df = docs(spark).union(spark.createDataFrame(extra, docs(spark).schema))
    got = pii.scan(df).collect()
    assert len(got) == len(rows()) + 2
    texts = [r[1] for r in rows() + extra]
    want = sorted(hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(t or "")).encode()).hexdigest() for t in texts)
    assert sorted(r.base_sha256 for r in got) == want
    row = next(r for r in got if r.doc_id == 201)
    assert (row.n_email, row.n_hidden_email, row.spans) == (1, 1, "email:2:9,email:10:22")
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    by = {r.doc_id: r for r in clean.collect() if r.doc_id and r.doc_id >= 100}
    assert by[200].text == "<EMAIL> and <IP>, <PHONE>" and by[200].n_chars == 25
    assert by[100].text is None and by[101].text == "" and by[106].n_chars == 9
    assert pii.scan(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1(" * 100_000, "four " * 60_000, "！" * 200_000, "x dot " * 50_000):
        pii.disguised(t, pii.find(t))


def test_licenses_by_brute_force(spark):
    texts = {
        1: "Licensed under CC BY-NC 4.0.",
        2: "Copyright. ALL RIGHTS, reserved! all rights reserved",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "released under the new MIT License",
        5: "cc by by cc by",
        6: "Permission is hereby granted, free of charge, to any (lucky) person obtaining a copy of this software and associated documentation files, to deal in the Software without any restriction",
        7: "general public Kicense",
        8: None,
        9: "",
    }
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in texts.items():
        w = word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        places = sorted((p, label) for label, ph in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1].labels == "cc-by,cc-by-nc-4.0" and got[3].labels == "gpl,gpl-3.0"
    assert got[6].labels == "mit" and got[6].score > 0.8
    assert licenses.scan(df).count() == 10
    assert licenses.scan(docs(spark)).count() == len(rows()) and licenses.scan(empty(spark)).count() == 0


ITEM = "which of the following rivers runs through the largest number of countries before it meets the sea in the north of the land".split()


def test_decontamination(spark):
    changed = ["other" if i % 5 == 4 else w for i, w in enumerate(ITEM)]  # 19 of 23 words are left, just over 80 %
    texts = {
        1: "before " + " ".join(ITEM) + " after",
        2: "before " + " ".join(changed) + " after",
        3: " ".join(ITEM[:8]) + " and then nothing of the kind was ever said again by the people there at all in any way",
        4: " ".join(reversed(ITEM)),
        5: " ".join(ITEM).upper(),
        6: None,
        7: "",
        8: "short words",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(ITEM), 1), (8, "too short an item", 2), (9, None, 3), (3, " ".join(ITEM), 1)], "item_id long, text string, key int")
    got = decontam.scan(df, items).collect()
    assert len(got) == 9 and set(got[0].asDict()) == {"doc_id", "text", "contaminated", "n_items", "item_id", "overlap"}
    assert {r.doc_id for r in got if r.contaminated} == {1, 2, 5}
    assert all((r.n_items, r.item_id, r.overlap) == (2, 3, 1.0) for r in got if r.doc_id in (1, 5))
    kept = decontam.clean(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 8]
    assert decontam.clean(docs(spark), items).count() == len(rows())
    assert decontam.scan(empty(spark), items).count() == 0
    assert decontam.scan(df, items.limit(0)).filter("contaminated").count() == 0


def test_rows_that_cannot_be_contaminated_stay_where_they_are(spark):
    """Neither few nor many contaminated rows make the texts of the others travel."""
    texts = [(i, f"row {i} " + (" ".join(ITEM) if i % 3 == 0 else "is clean")) for i in range(300)] + [(None, "no id"), (None, " ".join(ITEM))]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = [tuple(r) for r in decontam.clean(df, items).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == [t for t in texts if " ".join(ITEM) not in t[1]]


def test_every_overlap_of_four_fifths_is_found(spark):
    item = lambda n: [f"i{n}w{k}" for k in range(n)]
    items = [(n, " ".join(item(n))) for n in (*range(1, 13), 15, 20, 60)]
    alike = lambda n, c: any(5 * sum(lo <= x < lo + k for x in c) <= k for k in range(min(13, n), n + 1) for lo in range(n - k + 1))
    texts, found = [], {}
    for n, at_most in ((1, 0), (2, 0), (4, 0), (5, 1), (6, 1), (7, 1), (8, 1), (10, 2), (11, 2), (15, 3)):
        for m in range(at_most + 2):
            for changed in itertools.combinations(range(n), m):
                w = ["x" if k in changed else x for k, x in enumerate(item(n))]
                found[len(texts)] = n if alike(n, changed) else None
                texts.append((len(texts), " ".join(["before", *w, "after"])))
    for lo, hi, change in ((0, 13, ()), (20, 39, ()), (47, 60, (50, 55)), (20, 30, ()), (30, 43, (33, 36, 39))):
        found[len(texts)] = 60 if hi - lo >= 13 and len(change) <= 2 else None
        texts.append((len(texts), " ".join(["before", *("x" if k in change else f"i60w{k}" for k in range(lo, hi)), "after"])))
    df, of = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(df, of).collect()
    assert {r.doc_id: r.item_id for r in got} == found
    shuffled = decontam.scan(df, of, broadcast_bytes=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got))


def test_clashing_names(spark):
    """Columns named as the operators name theirs stay as they are."""
    df = clashing(spark)
    items = spark.createDataFrame([(7, " ".join(ITEM), "k")], "item_id long, text string, key string")
    outs = [decontam.scan(df, items), decontam.clean(df, items), mixing.mix(df), neardup.dedupe(df), pii.redact(df), language.keep_known(df)]
    outs.append(licenses.scan(df, keep=("doc_id", *CLASHES)))
    for out in outs:
        r = out.first().asDict()
        assert all(r[x] == f"my {x}" for x in CLASHES)
    assert decontam.clean(df, items).columns == df.columns
