import binascii
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import divergence, quality, spelling

from .edges import clashing, docs, empty, rows

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(table, least, top):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows, by the definition."""
    table = [tuple(x or "" for x in r) for r in table]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in table:
        terms = TERM.findall(text.translate(LOWER))
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {r[1] for r in table}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted({r[2] for r in table if r[1] == lang})
        whole = sum((count[lang, s] for s in sources), Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: p_of(count[lang, s]) for s in sources}, p_of(whole)
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def many_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "the,", "(the)", "Straße", "ÉTÉ", "été", "don't", "a-b", "x1y", "7", "--", "co\u00a0op", "tail"] + [f"w{i}." for i in range(40)]
    out = [(" ".join(rng.choices(words, weights=[40] + [3] * (len(words) - 1), k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None])) for _ in range(n)]
    return out + [(None, "en", "a"), ("", "nl", "z"), ("alone", "xx", "only"), (None, None, None)] + out[:5]


@pytest.mark.parametrize("least, held", [(30, 400_000), (3, 40), (60, 1)])
def test_source_divergence_by_brute_force(spark, least, held):
    table = many_rows(least)
    df = spark.createDataFrame(table, "text string, lang string, source string").repartition(5)
    got = sorted(map(tuple, divergence.audit(df, least=least, top=5, held=held, terms_at_once=16).collect()))
    assert got == brute_audit(table, least, 5)


def test_source_divergence_many_sources(spark):
    rng = random.Random(1)
    table = [(" ".join(rng.choices(["u", "v", "w", "x", "y"], k=6)), "en", f"s{rng.randrange(11)}") for _ in range(80)] + [(None, "en", "silent")]
    df = spark.createDataFrame(table, "text string, lang string, source string")
    got = sorted(map(tuple, divergence.audit(df, least=3, block=3, terms_at_once=2).collect()))
    assert got == brute_audit(table, 3, 50)


def test_source_divergence_edges(spark):
    got = sorted(map(tuple, divergence.audit(docs(spark), least=2).collect()))
    assert got == brute_audit([(t, lang, s) for _, t, lang, s, *_ in rows()], 2, 50)
    assert sorted(map(tuple, divergence.audit(clashing(spark), least=2).collect())) == got
    assert divergence.audit(empty(spark)).count() == 0


def brute_variants(table, rarest=5, shortest=6, dropped=199):
    count = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = binascii.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % dropped == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= rarest}
    near = defaultdict(set)
    for a in words:
        for i in range(len(a)):
            near["-", a[:i] + a[i + 1 :]].add(a)
            near[i, a[:i], a[i + 1 :]].add(a)
    alike = defaultdict(set)
    for key, ws in near.items():
        if key[0] == "-":
            for a in ws & {a for a in ws if key[1] in words}:
                alike[a].add(key[1])
                alike[key[1]].add(a)
        else:
            for a in ws:
                alike[a] |= ws - {a}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in alike[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(alike[w]), words.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def variant_rows(seed, n=400):
    rng = random.Random(seed)
    letters = "abcdeéßÀ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["a" * 130, "a" * 129 + "b", "a" * 131]
    def word():
        w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
        for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", rng.choice(letters), rng.choice(letters) + w[i]]) + w[i + 1 :]
        return rng.choice([w, w, w.upper() if w.isascii() else w, w.capitalize() if w[0].isascii() else w])
    out = [(rng.choice([i, i, None]), " ".join(word() + rng.choice(["", "", ".", "\u0100", "1"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    chain = [(1000 + i, "chainone " * 20 + "chainonf " * 3) for i in range(12)] + [(2000, "chainomf " * 6)]
    return out + [(900, None), (901, ""), (None, None)] + out[:9] + chain


@pytest.mark.parametrize("how", [{}, {"part_words": 12, "sample": 4000, "leaf": 3}, {"part_words": 12, "sample": 30, "leaf": 1}])
def test_spelling_variants_by_brute_force(spark, how):
    table = variant_rows(8)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    want = brute_variants(table)
    got = sorted(map(tuple, spelling.group_variants(df, **how).collect()), key=lambda r: r[0])
    assert got == want
    assert sum(r[4] > 0 for r in want) > 50 and sum(r[1] is not None for r in want) > 10 and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_edges(spark):
    want = brute_variants([(i, t) for i, t, *_ in rows()])
    for df in (docs(spark), clashing(spark)):
        assert sorted(map(tuple, spelling.group_variants(df).collect()), key=lambda r: r[0]) == want
    assert spelling.group_variants(empty(spark)).count() == 0
    long_run = "ab" * 2_500_000
    assert [len(w) for part in spelling.runs(f"x {long_run} y") for w in part] == [1, 5_000_000, 1]


def test_boxes_lose_no_neighbour():
    rng = np.random.default_rng(3)
    letters = rng.choice(spelling.SYMBOLS[:7], (500, 6))
    counts = spelling.counts_of(letters)
    for leaf in (1, 8, 1000):
        tree = spelling.Tree.build(counts, leaf)
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
        for more, less in ((1, 1), (1, 0), (0, 1), (0, 0)):
            reached = {(int(q), int(r)) for at, rows_ in tree.search(counts, more, less) for q in rows_ for r in tree.leaves[at]}
            change = counts[None].astype(int) - counts[:, None]
            inside = (np.maximum(change, 0).sum(2) <= more) & (np.maximum(-change, 0).sum(2) <= less)
            assert set(zip(*map(lambda x: x.tolist(), np.nonzero(inside)))) <= reached


def graded(n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        if not good:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x for x in w[:3] for _ in range(8)]
        out.append((i, " ".join(w), int(good)))
    return out


def test_quality(spark):
    table = graded()
    df = spark.createDataFrame([(i, t) for i, t, _ in table] + [(9001, None), (9002, ""), (9003, " "), (0, table[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in table] + [(9001, 1), (5, None), (None, 1), (7, 3), (99999, 0)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = quality.score(df.withColumn("held", held), labels, learn_from=~F.col("held"), keep=("doc_id", "held")).collect()
    truth = {i: q for i, _, q in table}
    assert len(got) == len(table) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in got if r.held and r.doc_id < 9000) > 0.97 * sum(r.held and r.doc_id < 9000 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[9001] == by[9002] == by[9003]
    again = quality.score(df.repartition(3).withColumn("held", held), labels.repartition(2), learn_from=~F.col("held"), keep=("doc_id", "held")).collect()
    assert {r.doc_id: r.score for r in again} == by
    # what is held out teaches nothing
    other = labels.join(df.select("doc_id", held.alias("held")), "doc_id", "left").withColumn("quality", F.when(F.col("held"), 1 - F.col("quality")).otherwise(F.col("quality")))
    same = quality.score(df.withColumn("held", held), other.select("doc_id", "quality").distinct(), learn_from=~F.col("held")).collect()
    assert {r.doc_id: r.score for r in same} == by


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.score(clashing(spark), labels, keep=("doc_id", "a.b")).collect()
    assert len(got) == len(rows()) and all(r["a.b"] == "my a.b" for r in got)
    assert quality.score(empty(spark), labels).count() == 0
    assert {r.score for r in quality.score(docs(spark), labels.limit(0)).collect()} == {0.5}
    one_class = quality.score(docs(spark), labels.filter("quality = 0")).collect()
    assert all(r.score < 0.5 for r in one_class)


def test_quality_updates_by_the_formula():
    rng = np.random.default_rng(2)
    state, z, n = quality.State.new(), defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    for _ in range(200):
        at = np.unique(rng.integers(0, 30, 6))
        x, label = rng.random(len(at)), int(rng.random() < 0.5)
        state.learn(at, x, label)
        row = [*zip(at.tolist(), x.tolist()), (quality.FEATURES, 1.0)]
        w = {i: weight(i) for i, _ in row}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in row)))
        for i, v in row:
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
            n[i] += g * g
    got = state.weights()
    assert all(got[i] == pytest.approx(weight(i)) for i in [*range(30), quality.FEATURES])


def test_quality_features_of_pieces(monkeypatch):
    """Words, shapes and repeats; a long text in pieces has the features of the whole, but for n-grams across pieces."""
    text = "One two,, TWO two 77 été!! One"
    words, shapes = quality.words_of(text.encode())
    assert len(words) == len(shapes) == 9
    assert words[1] == words[3] == words[4] and words[0] == words[8] and len(set(words.tolist())) == 6
    assert shapes[0] == shapes[8] and shapes[3] != shapes[1] and shapes[4] != shapes[1]
    long_text = " ".join(f"w{i % 50}" for i in range(900_000))
    i, x = quality.features(long_text)
    assert abs((x * x).sum() - 2) < 0.1 and len(i) < 400
    assert len(quality.features(None)[0]) == len(quality.features(" ")[0]) == 0
