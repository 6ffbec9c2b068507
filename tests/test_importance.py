import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritab.operators import features, importance
from veritab.operators.facts import TableFacts


def brute_tree(x: np.ndarray, y: np.ndarray, depth: int) -> dict:
    """Every split of every node tried by itself."""
    gains: dict = {}

    def squares(part):
        return sum(n * n for n in pd.Series(part).value_counts()) / len(part)

    def grow(rows, level):
        best = (1e-9, None, None)
        for f in range(x.shape[1]):
            for cut in sorted(set(x[rows, f]))[:-1]:
                low = x[rows, f] <= cut
                gain = squares(y[rows][low]) + squares(y[rows][~low]) - squares(y[rows])
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
        if best[1] is None:
            return
        gains[best[1]] = gains.get(best[1], 0.0) + best[0]
        low = x[rows, best[1]] <= best[2]
        if level + 1 < depth:
            grow(rows[low], level + 1)
            grow(rows[~low], level + 1)

    grow(np.arange(len(x)), 0)
    return {f: g / sum(gains.values()) for f, g in gains.items()}


@pytest.mark.parametrize("block_rows", [15, 1_000_000])
def test_tree_by_brute_force(spark, block_rows, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 12, 160), rng.normal(size=160).round(1), rng.integers(0, 2, 160)]).astype(float)
    y = np.where(x[:, 0] > 7, "a", np.where(x[:, 1] > 0.3, "b", np.where(rng.random(160) < 0.2, "c", "d")))
    df = spark.createDataFrame(pd.DataFrame({"label": y, "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2]}))
    splits = importance.best_splits
    monkeypatch.setattr(importance, "best_splits", lambda cells: splits(cells, block_rows))
    got = importance.class_importances(df, 3, 2)
    want = brute_tree(x, y, 2)
    assert set(got) == set(want) and all(got[f] == pytest.approx(want[f]) for f in want)


def test_texts_are_numbered_as_they_appear(spark):
    rows = [(i, ["zebra", "ant", None, "bee"][i % 4], float(i % 3)) for i in range(40)]
    facts = TableFacts(spark.createDataFrame(rows, "id long, animal string, target double").repartition(3), "id")
    got = importance.encoded(facts, ["animal"], F.col("target")).groupBy("x0").count().collect()
    assert {r.x0: r["count"] for r in got} == {0.0: 10, 1.0: 10, -1.0: 10, 2.0: 10}
    codes = {(r.a, r.b): r.code for r in importance.ordinals(facts, ["animal"]).collect()}
    named = facts.df.select("animal", *[h.alias(n) for n, h in zip("ab", importance.hashes(F.col("animal")))]).where("animal is not null").distinct()
    assert {r.animal: codes[r.a, r.b] for r in named.collect()} == {"zebra": 0, "ant": 1, "bee": 2}


def test_importance_of_classes_and_numbers(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "kind": rng.choice(["p", "q", "r"], 300), "n": np.arange(300)})
    pdf["target"] = np.where(pdf["a"] > 0.2, "yes", "no")
    pdf.loc[::17, "kind"] = None
    f = TableFacts(spark.createDataFrame(pdf), "n")
    assert [tuple(r) for r in features.feature_importance(f, "target").collect()] == [("a", 1.0)]
    pdf["target"] = np.where(pdf["kind"] == "q", 50.0, 0.0) + rng.random(300)
    f = TableFacts(spark.createDataFrame(pdf), "n")
    assert features.feature_importance(f, "target").first().feature == "kind"
    pdf["target"] = 1.0
    assert features.feature_importance(TableFacts(spark.createDataFrame(pdf), "n"), "target").count() == 0
