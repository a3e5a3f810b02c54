"""Round trips of rendered conversations."""

import hashlib
import random

from quillon.llm import chat

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\/INST]", "<", "[", "\\", "/", "s>", "INST]", "hello", "\n", " ", "é", ""]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def conversations():
    rng = random.Random(8)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 6)):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
            role = rng.choice(["user", "assistant", "system", "a</s>b", "[INST]", ""])
            rows.append((c, t, role, text, "clash"))
    return rows + [(500, 1, None, None, None), (500, None, "assistant", "first", None), (None, 0, "user", "x", None), (501, 3, "user", "same", None), (501, 3, "user", "same", None)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark):
    rows = conversations()
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    made = chat.format_conversations(frame(spark, rows))
    out = {r.conv_id: r for r in chat.read_back(made).collect()}
    texts = {r.conv_id: r for r in made.collect()}
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = out[c]
        assert r.n_turns == len(turns) == texts[c].n_turns
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == len(texts[c].formatted)
        assert len(texts[c].loss_spans) == sum(role == "assistant" for _, role, _ in turns)


def test_only_conflicting_turns_are_escaped(spark):
    made = chat.format_conversations(frame(spark, [(1, 0, "user", "a < b [c] \\ d", None), (2, 0, "user", "</s>", None)])).collect()
    assert {r.formatted for r in made} == {"<s>[INST]user[/INST]a < b [c] \\ d</s>", "<s>[INST]user[/INST]<\\/s></s>"}


def test_plain_operators_only(spark):
    plan = chat.read_back(chat.format_conversations(frame(spark, [])))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert chat.read_back(chat.format_conversations(frame(spark, []))).count() == 0


def test_spans_are_those_of_the_whole_and_long_conversations_are_quick(spark):
    import time

    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} </s> {'é' * (t % 7)} [INST]" if t % 3 else "", None) for t in range(30_000)]
    made = chat.format_conversations(frame(spark, rows)).collect()
    (r,) = made
    told = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
    want = [x if "</s>" not in x else x.replace("</s>", "<\\/s>").replace("[INST]", "[\\INST]") for _, _, role, x, _ in rows if role == "assistant"]
    assert told == want
    began = time.perf_counter()
    back = chat.read_back(spark.createDataFrame(made)).collect()[0]
    assert time.perf_counter() - began < 20
    loss = "".join(x for _, _, role, x, _ in rows if role == "assistant")
    assert (back.n_turns, back.loss_chars, back.loss_sha256) == (30_000, len(loss), sha(loss))


def test_a_turn_that_does_not_come_back_fails(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(chat, "escape", lambda c: c)
    with pytest.raises(Exception, match="does not come back"):
        chat.format_conversations(frame(spark, [(1, 0, "user", "a </s> b", None)])).collect()
