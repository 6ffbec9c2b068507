import binascii
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.llm import ann, classlm, language, neardup, tokens

from .edges import docs, empty, rows


def test_automata_phrases_by_brute_force():
    sample = [("a", ["abracadabra cat", "banana"]), ("b", ["the cat sat on the mat"])]
    model = language.Automata(sample)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abct hesm") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    segments = [s for t in texts if len(s := model.encode(t))]
    got = model.phrases(segments)
    for row, (_, pieces) in enumerate(sample):
        known = bytes(model.encode(" ".join(pieces)))
        for j, s in enumerate(segments):
            s, at, n = bytes(s), 0, 0
            while at < len(s):
                k = 1
                while at + k < len(s) and s[at : at + k + 1] in known:
                    k += 1
                at, n = at + k, n + 1
            assert abs(got[row, j] - n) <= 0, (row, texts[j])


def test_language(spark):
    df = docs(spark)
    got = language.identify(df).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en", "de", "fr")[i % 3] for i in range(60))
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102, 103)) and by[104].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {*range(60), 104, 105, 106} and kept.count() == len(rows()) - 5
    assert language.identify(empty(spark)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def many_letters(lang: str, n: int, seed: int) -> str:
    """Prose of invented words of two letters out of 1,500 Chinese ones; the words differ by language, the letters do not."""
    words = random.Random(lang)
    vocabulary = [chr(0x4E00 + words.randrange(1500)) + chr(0x4E00 + words.randrange(1500)) for _ in range(1200)]
    rng = random.Random(seed)
    return "".join(vocabulary[int(1200 * rng.random() ** 3)] + ("，" if rng.random() < 0.1 else "") for _ in range(n // 2))


CYRILLIC = "старый дом у реки был пуст и люди которые жили рядом были добры к каждому путнику что шёл по дороге мимо них"


def test_languages_of_many_letters(spark):
    data = [(i, many_letters(lang, 400, i), lang) for i in range(160) for lang in [("zh", "yue")[i % 2]]]
    data += [(1000 + i, " ".join(CYRILLIC.split()[i % 7 :] + CYRILLIC.split()[: i % 7]), "ru") for i in range(20)]
    data += [(2000 + i, t, lang) for i, t, lang, *_ in rows()[:60]]
    rng = random.Random(5)
    junk = ["".join(chr(a + rng.randrange(n)) for _ in range(300)) for a, n in ((0x4E00, 1500), (0xAC00, 9000), (0x430, 32), (97, 26))]
    data += [(3000 + i, t, None) for i, t in enumerate(junk)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    learn = F.col("doc_id") % 4 < 2
    got = {r.doc_id: r for r in language.identify(df, learn_from=learn, keep=("doc_id", "lang")).collect()}
    assert all(r.lang_pred == r.lang for r in got.values() if r.lang)
    assert {r.doc_id for r in language.keep_known(df, learn_from=learn).collect()} == {i for i in got if i < 3000}


def test_rare_letters_by_brute_force():
    sample = [(lang, [many_letters(lang, 900, 1), many_letters(lang, 900, 2)]) for lang in ("zh", "yue")] + [("ru", [CYRILLIC])]
    model = language.Automata(sample, symbols=20)
    segments = [model.encode(many_letters(lang, 60, 7) + CYRILLIC[k : k + 9]) for k in range(20) for lang in ("zh", "yue")]
    got = model.phrases(segments)
    for row, (_, pieces) in enumerate(sample):
        known = "".join(map(chr, model.encode(" ".join(pieces).lower())))
        for j, s in enumerate(segments):
            s, at, n = "".join(map(chr, s)), 0, 0
            while at < len(s):
                k = 1
                while at + k < len(s) and s[at : at + k + 1] in known:
                    k += 1
                at, n = at + k, n + 1
            assert got[row, j] == n


def brute_components(texts: dict, size: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    comp = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                both = len(sets[a] & sets[b])
                if both and comp[a] < comp[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    comp[b] = comp[a]
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in texts}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, size, percent):
    rng = random.Random(size)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    texts = {}
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9999)}"
        texts[i] = " ".join(w)
    texts |= {200: None, 201: "", 202: "two words", 203: "Two  WORDS", 204: "two words more", 205: " "}
    got = neardup.cluster(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size, percent).collect()
    want = brute_components(texts, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    df = docs(spark)
    kept = neardup.dedupe(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[105] == 1 and ids[100] == ids[101] == ids[102] == 1 and ids[104] == 1
    nameless = spark.createDataFrame([(None, "one two three four five six")] * 3 + [(4, "one two three four five six"), (None, "other words that stand alone here")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.cluster(nameless).collect()} == {(None, 4, False), (4, 4, True), (None, None, False)}
    assert neardup.cluster(empty(spark)).count() == 0


def test_word_hashes_follow_words():
    text = "Ein  zwei\tEIN drei\n\x0bzwei é É"
    h, start, end = neardup.hash_words(text.encode())
    words = [text.encode()[a:b].lower() for a, b in zip(start, end)]
    assert words == text.encode().lower().split()
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[2] and h[5] != h[6]


def test_vector_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24)) * rng.uniform(0.5, 2, size=(900, 1))
    rows_ = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows_ += [(1000, [0.0] * 24), (1001, None), (1002, [None] + [1.0] * 23), (1003, [float("nan")] * 24), (1004, [float("inf")] + [1.0] * 23), (1020, [1.0] * 3)]
    rows_ += [(2000 + i, rows_[0][1]) for i in range(30)] + [(None, rows_[0][1]), (5, rows_[5][1])]
    df = spark.createDataFrame(rows_, "id long, vector array<double>")
    got = {}
    for r in ann.search(df, df.filter("id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    usable = {i: np.array(v) for i, v in rows_ if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in usable if i % 20 == 0}
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        best = sorted(((-float(v @ usable[q]), i) for i, v in usable.items() if i != q))[:20]
        assert [r.rank for r in rs] == list(range(1, 21)) and q not in [r.vec_id for r in rs]
        assert all(r.score == pytest.approx(float(usable[r.vec_id] @ usable[q]), abs=1e-9) for r in rs)
        assert [(-round(r.score, 9), r.vec_id) for r in rs] == sorted((-round(r.score, 9), r.vec_id) for r in rs)
        hits += len({i for _, i in best} & {r.vec_id for r in rs})
    assert hits / 20 / len(got) >= 0.9
    few = spark.createDataFrame(rows_[:3], "id long, vector array<double>")
    assert ann.search(few, few.filter("id = 0")).count() == 2
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_class_model(spark):
    df = docs(spark).withColumn("train", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False)))
    got = classlm.score(df, learn_from=F.col("train"), keep=("doc_id", "train")).collect()
    toks = [(i, (t or "").encode().lower().split() + [None], i is not None and binascii.crc32(str(i).encode()) % 10 != 0) for i, t, *_ in rows()]
    c = Counter(w for _, x, train in toks if train for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 5)) for i, x, _ in toks)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert classlm.score(empty(spark)).count() == 0
    untrained = classlm.score(df, learn_from=F.lit(False)).collect()
    assert len(untrained) == len(toks) and all(r.n_known == 0 for r in untrained)


def _stream(classes, many, seed):
    """Texts of numbered types, classes drawn for them, and what the model counts of them by recounting every text."""
    rng = np.random.default_rng(seed)
    kind = np.arange(many) % 3  # types follow types of the next kind
    texts = []
    for _ in range(120):
        w, x = int(rng.integers(1, many)), []
        for _ in range(25):
            x.append(w)
            w = int(rng.choice(np.flatnonzero((kind == (kind[w] + 1) % 3) & (np.arange(many) > 0))))
        texts.append(np.array([*x, 0]))
    of = np.concatenate([[0], rng.integers(1, classes, many - 1), [classes]])

    def total(of):
        t = np.zeros((classes + 1, classes + 1))
        for x in texts:
            np.add.at(t, (np.concatenate([[classes], of[x][:-1]]), of[x]), 1)
        return t

    near = {w: Counter() for w in range(1, many)}
    for x in texts:
        for i, w in enumerate(x[:-1]):
            near[w][int(classes if i == 0 else of[x[i - 1]])] += 1
            near[w][int(classes + 1 + of[x[i + 1]])] += 1
    return of, total, [(w, [(k, n) for k, n in c.items()]) for w, c in near.items() if c]


def test_moves_of_types_equal_a_recount():
    """One type alone: the class a recount of all texts finds best, and the class bigrams that follow from it."""
    of, total, near = _stream(5, 40, 3)
    start = total(of)
    arrow = pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in near], pa.int32()), pa.array([[{"k": k, "n": n} for k, n in x] for _, x in near], arrow)], names=["t", "near"])
    moved = 0
    for w, _ in near:
        got = next(classlm._moves(iter([batch]), of, start, w, 40))  # the share of this type alone
        went = np.frombuffer(got.column("moved")[0].as_py(), np.int32)
        new = of.copy()
        new[went] = np.frombuffer(got.column("into")[0].as_py(), np.int16)
        assert set(went) <= {w}
        assert np.array_equal(start + np.frombuffer(got.column("delta")[0].as_py()).reshape(start.shape), total(new))
        ways = [classlm.likelihood(total(np.where(np.arange(len(of)) == w, c, of))) for c in range(1, 5)]
        assert math.isclose(classlm.likelihood(total(new)), max(ways), rel_tol=1e-12)
        moved += len(went)
    assert moved > 10


def test_refining_never_lowers_the_likelihood(spark):
    """Also from classes that are all empty but one, and with shares that move together."""
    for lone in (False, True):
        of, total, near = _stream(6, 60, 4)
        if lone:
            of, near = np.where((of > 0) & (of < 6), 1, of), [(w, sorted(Counter({k if k in (0, 6, 7) else (1 if k < 6 else 8): 0 for k, _ in x}).items())) for w, x in near]
            near = [(w, [(k, sum(n for j, n in y if (j if j in (0, 6, 7) else (1 if j < 6 else 8)) == k)) for k, _ in x]) for (w, x), (_, y) in zip(near, _stream(6, 60, 4)[2])]
        df = spark.createDataFrame(near, "t int, near array<struct<k: int, n: long>>").repartition(3)
        new, bigrams = classlm.refine(df, of, total(of))
        assert classlm.likelihood(bigrams) >= classlm.likelihood(total(of))
        assert set(new[1:-1]) <= set(range(1, 6)) and new[0] == 0 and new[-1] == 6
        assert lone or classlm.likelihood(bigrams) > classlm.likelihood(total(of)) + 1
    empty_ = spark.createDataFrame([], "t int, near array<struct<k: int, n: long>>")
    same, _ = classlm.refine(empty_, of, total(of))
    assert np.array_equal(same, of)


def test_rare_words_get_classes_of_their_own(spark):
    """Words far below one in 10,000 tokens are told apart by what stands around them."""
    texts = [" ".join(f"{'abc'[(i + j) % 3]}word x{'abc'[(i + j) % 3]}{(i * 7 + j) % 4000}q" for j in range(60)) for i in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, classlm.FREQUENT = classlm.FREQUENT, 0.01
    try:
        got = classlm.score(df, learn_from=F.col("doc_id") % 10 != 0).collect()
        kept, classlm.refine = classlm.refine, lambda near, of, total: (of, total)
        grouped = classlm.score(df, learn_from=F.col("doc_id") % 10 != 0).collect()
    finally:
        classlm.FREQUENT, classlm.refine = before, kept
    held = [sum(r.score for r in rows if r.doc_id % 10 == 0) for rows in (got, grouped)]
    assert held[0] > held[1] + 100


def test_class_model_is_a_distribution():
    """Class bigrams sum to one from every state; so do the words of a class."""
    types = classlm.Types(np.array([5, 9, classlm.END], np.uint64))
    of = np.concatenate([[1, 2, 0], 1 + np.arange(classlm.GROUPS) % 2, [3]])
    of[np.searchsorted(types.words, classlm.END)] = 0
    freq = np.ones(types.many)
    big = np.random.default_rng(1).integers(0, 9, (4, 4)).astype(float)
    m = classlm.Model(types, of, big, freq, np.zeros(classlm.GROUPS), np.zeros(0, np.uint64), np.zeros(0), 10, 3, 3)
    assert np.allclose((10**m.step).sum(axis=1), 1)
    assert np.allclose(np.bincount(of[:-1], weights=10**m.emit), 1)


def test_token_trees():
    counter = tokens.Counter(open(tokens.DEFAULT_VOCABULARY).read().split("\n")[:-1])
    rng = random.Random(9)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'l", "l", "s", "é", "1", "!", " the", "ll", " \n", "😀"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 600])))
        tree = tokens.Tree.build(t, counter)
        assert tree.tokens == len(counter.encode(t))
        for _ in range(6):
            a = rng.randint(0, len(t) + 2)
            b = a + rng.choice([0, 0, 1, 3, 200])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 300])))
            tree.edit(a, b, new, counter)
            t = t[: min(a, len(t))] + new + t[min(b, len(t)) :]
            assert "".join(tree.texts) == t and tree.tokens == len(counter.encode(t))


def test_token_counts_with_edits(spark):
    encode = tokens.Counter(open(tokens.DEFAULT_VOCABULARY).read().split("\n")[:-1]).encode
    built = tokens.build(docs(spark))
    assert sorted(r.n_tokens for r in built.collect()) == sorted(len(encode(t or "")) for _, t, *_ in rows())
    edits = spark.createDataFrame([(104, 2, 10, 12, "zz"), (104, 1, 0, 5, None), (101, 1, 7, 9, "new text"), (100, 1, None, None, "x")], "doc_id long, seq int, start int, stop int, text string")
    after = tokens.edit(built.join(tokens.gather_edits(edits), "doc_id", "left"))
    by = {r.doc_id: r for r in after.collect() if r.doc_id}
    long_text = next(t for i, t, *_ in rows() if i == 104)
    new = long_text[5:15] + "zz" + long_text[17:]
    assert by[104].text == new and by[104].n_tokens == len(encode(new)) and by[104].encoded_chars < 2000
    assert by[101].text == "new text" and by[100].text == "x" and by[106].encoded_chars == 0
    again = tokens.edit(after.withColumn("edits", F.array(F.struct(F.lit(3).alias("start"), F.lit(4).alias("stop"), F.lit("q").alias("text")))))
    assert all(r.n_tokens == len(encode(r.text)) for r in again.collect())
    assert tokens.build(empty(spark)).count() == 0
