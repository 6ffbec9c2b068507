import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veritab.llm import chat, mixing

from .edges import docs, empty, rows


def water_filling(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    """By the rule itself: give by weight, stop at the cap, give the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / whole for s in open_}
        left = 0.0
        for s, x in given.items():
            target[s] += x
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_targets(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(rows())
    assert {"doc_id", "lang", "label", "n_chars", "size", "source_size", "target", "taken"} <= set(got[0].asDict())
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    expected = water_filling(sizes)
    taken, copies = defaultdict(int), Counter((r.doc_id, r.text) for r in got)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in expected.items():
        assert int(t + 1e-6) - max(copies.values()) <= taken[s] <= t + 1e-6
    again = mixing.mix(docs(spark).repartition(7)).select("doc_id", "text", "taken")
    assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.text, r.taken) for r in got)
    epochs = mixing.expand(mixing.mix(docs(spark))).agg(F.sum("words")).first()[0]
    assert epochs == sum(taken.values())


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
    only_blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(only_blank).collect()] == [0, 0]


def test_mix_one_source_and_ties(spark):
    same = spark.createDataFrame([(1, "a b c", None)] * 5, "doc_id long, text string, source string")
    got = mixing.mix(same).collect()
    assert len({r.taken for r in got}) == 1 and 22 - 5 <= sum(r.taken for r in got) <= 22


CHAT = "conv_id long, turn long, role string, text string, start int, extra string"


def turns():
    hot = [(5, t, "user" if t % 2 == 0 else "assistant", f"turn {t} <#\\> é", 0, "x") for t in range(300)]
    return hot + [
        (1, 0, "user", r"\### Assistant: </turn> ok", 0, "x"),
        (1, 1, "assistant", r"\### Assistant: </turn> ok", 0, None),
        (1, 2, "assistant", None, None, None),
        (1, 3, "user", "", 0, None),
        (2, 0, "assistant", "", 0, None),
        (2, 0, "assistant", "", 0, None),
        (None, 0, "user", "no id", 0, None),
        (None, None, None, None, None, None),
        (3, 0, "user\n>", "odd role", 0, None),
        (4, 0, "user", "x" * 200_000 + "\n<turn assistant>", 0, None),
        (4, 1, "assistant", "y" * 100_000, 0, None),
    ]


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(spark.createDataFrame(turns(), CHAT))).collect()}
    by = defaultdict(list)
    for c, t, role, text, *_ in turns():
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        contexts = [hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts[:i]).encode()).hexdigest() for i in range(len(ts)) if ts[i][1] == "assistant"]
        assert got[c].n_examples == len(contexts)
        assert got[c].contexts_sha256 == hashlib.sha256("".join(contexts).encode()).hexdigest()


def test_chat_wrong_contexts_change_the_digest(spark):
    pieces = chat.format_turns(spark.createDataFrame([t for t in turns() if t[0] == 1], CHAT))
    right = chat.digest(pieces).first()
    rows_ = [r.asDict() for r in chat.expand(pieces).collect()]
    at = next(r for r in rows_ if not r["is_piece"] and r["position"] > 0)
    schema = chat.expand(pieces).schema
    pieces_at = sorted(r["position"] for r in rows_ if r["is_piece"])
    for wrong in [at["position"] - 1, at["position"] + 1, *(p for p in pieces_at if p != at["position"])]:
        moved = [r | {"position": wrong} if r is at else r for r in rows_]
        got = chat.read_back(spark.createDataFrame([tuple(r.values()) for r in moved], schema)).first()
        assert got.contexts_sha256 != right.contexts_sha256 and got.turns_sha256 == right.turns_sha256, wrong


def test_chat_examples_hold_all_turns_before(spark):
    pieces = chat.format_turns(spark.createDataFrame([t for t in turns() if t[0] in (1, 3, 5) and (t[1] or 0) < 12], CHAT))
    rows_ = sorted((r for r in pieces.collect() if r.conv_id == 5), key=lambda r: r.start)
    written = {r.turn: r for r in chat.write_out(pieces).collect() if r.conv_id == 5}
    assert sorted(written) == [1, 3, 5, 7, 9, 11]
    text = ""
    for r in rows_:
        assert r.start == len(text)
        if r.context_end is None:
            assert r.loss_start is None and r.turn not in written
        else:
            assert r.context_end == r.start and written[r.turn].context == text and written[r.turn].target == r.piece
            assert chat.ESCAPED.sub(r"\1", r.piece[r.loss_start : r.loss_end]) == f"turn {r.turn} <#\\> é"
        text += r.piece


def test_chat_examples_in_parts(spark):
    pieces = chat.format_turns(spark.createDataFrame([t for t in turns() if t[0] != 4 and (t[1] or 0) < 12], CHAT))
    parts = defaultdict(list)
    for r in chat.write_parts(pieces).collect():
        parts[r.conv_id, r.example].append(r)
    stored = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: r.start):
        stored[r.conv_id].append(r)
    replies = [r for rows_ in stored.values() for r in rows_ if r.context_end is not None]
    assert set(parts) == {(r.conv_id, r.start) for r in replies} and len(replies) == 10
    for r in replies:
        got = sorted(parts[r.conv_id, r.start], key=lambda x: x.part)
        assert [x.piece for x in got] == [x.piece for x in stored[r.conv_id] if x.start <= r.start]
        assert [(x.loss_start, x.loss_end) for x in got] == [(None, None)] * (len(got) - 1) + [(r.loss_start, r.loss_end)]


def test_chat_empty(spark):
    assert chat.write_parts(chat.format_turns(spark.createDataFrame([], CHAT))).count() == 0
    assert chat.digest(chat.format_turns(spark.createDataFrame([], CHAT))).count() == 0
