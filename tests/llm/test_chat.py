import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import chat, packing
from docloom.llm.registry import vocabulary

TURNS = "conv_id long, turn long, role string, text string"


def talks():
    rng = random.Random(8)
    bits = ["hello", "</s>[INST] ok [/INST]", "<|im_end|>\n", "\\", "\\<|im_start|>", "é京", "<|endoftext|>", "", "line\nbreak", "word " * 30, "[INST", "<s><s>"]
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 5, 9, 200 if conv == 7 else 4])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "system"])
            rows.append((conv, turn, role, rng.choice([None, " ".join(rng.choices(bits, k=rng.randint(1, 6)))])))
    rows.append((90, 0, "user", "big " * 3_000))
    rows.append((90, 1, "assistant", "answer " * 2_000))
    rows.append((90, 2, "user\n<|im_end|>", "after"))
    rows += [(91, 0, "system", "alone"), (92, None, None, None), (92, 1, "assistant", "x"), (None, 0, "user", "no id"), (93, 1, "user", "twin"), (93, 1, "user", "twin")]
    return rows


def size_of(role, text):
    """Tokens of a turn whose text holds no control string but such as are escaped."""
    text = text.replace("\\", "\\\\")
    for control in sorted(chat.CONTROL, key=len, reverse=True):
        text = text.replace(control, control[0] + "\\" + control[1:])
    return len(packing.ByteBpe(*vocabulary()).encode(f"{chat.START}{role}\n{text}{chat.END}\n")) // 4


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(128, 40), chat.Budget(64, 0)])
def test_read_back(spark, budget):
    rows = talks()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{TURNS}, row int, c string").repartition(3)
    windows = chat.chat_windows(frame, vocabulary(), budget).cache()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(windows).collect()}
    assert out == brute(rows)
    for w in windows.collect():
        turns = chat.read_turns(w.text)
        assert len(turns) == w.n_turns and w.n_repeated < w.n_turns
        assert w.oversize == (w.tokens > budget.window)
        first = min((r for r in rows if r[0] == w.conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        if first[2] == "system" and size_of("system", first[3] or "") <= budget.largest_system:
            assert turns[0] == ("system", first[3] or "")
        if w.oversize:
            assert w.n_turns - w.n_repeated <= 2


def test_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "some words to say " * (i % 5 + 1)) for i in range(1, 400)]
    budget = chat.Budget(160, 40)
    windows = sorted(chat.chat_windows(spark.createDataFrame(rows, TURNS), vocabulary(), budget).collect(), key=lambda r: r.start)
    assert len(windows) > 20 and all(w.tokens <= budget.window and not w.oversize for w in windows)
    assert all(w.n_repeated >= 1 for w in windows[1:]) and any(w.n_repeated > 1 for w in windows)


def test_windows_are_filled(spark):
    rng = random.Random(6)
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", "some words to say " * rng.randint(1, 60)) for c in range(3) for i in range(300)]
    windows = chat.chat_windows(spark.createDataFrame(rows, TURNS), vocabulary()).collect()
    last = {r.conv_id: max(w.start for w in windows if w.conv_id == r.conv_id) for r in windows}
    full = [w.tokens for w in windows if w.start != last[w.conv_id]]
    assert sum(full) / len(full) > 0.85 * 2_048 and max(full) <= 2_048


def test_a_long_system_turn_does_not_multiply(spark):
    rows = [(1, 0, "system", "rule " * 20_000)] + [(1, i, "user" if i % 2 else "assistant", "some words to say " * 40) for i in range(1, 41)]
    windows = sorted(chat.chat_windows(spark.createDataFrame(rows, TURNS), vocabulary()).collect(), key=lambda w: w.start)
    assert [w.oversize for w in windows] == [True] + [False] * (len(windows) - 1)
    assert windows[0].n_turns == 1 and sum(w.tokens for w in windows) < 1.5 * sum(size_of(r, t) for _, _, r, t in rows)


def test_chunks_of_a_long_conversation(spark, monkeypatch):
    """Every turn is new in one window, in order, whatever chunks cut the conversation."""
    rng = random.Random(2)
    rows = [(1, 0, "system", "be kind")] + [(1, i, "assistant", f"turn {i} " + "word " * rng.choice([0, 3, 20, 20, 90])) for i in range(1, 500)]
    monkeypatch.setattr(chat, "CHUNK_WINDOWS", 2)
    monkeypatch.setattr(chat, "TURN_BLOCK", 7)
    windows = sorted(chat.chat_windows(spark.createDataFrame(rows, TURNS), vocabulary(), chat.Budget(200, 50)).collect(), key=lambda w: w.start)
    fresh = []
    for w in windows:
        turns = chat.read_turns(w.text)
        assert turns[0] == ("system", "be kind") and w.tokens <= 200
        history = turns[1 : w.n_repeated] if fresh else []
        assert [t for _, t in history] == (fresh[-len(history) :] if history else [])
        fresh += [t for _, t in turns[(1 if not fresh else w.n_repeated) :]]
        said = [chat.unescaped(w.text[s.start : s.end]) for s in w.loss]
        assert said == [t for r, t in turns[w.n_repeated :] if r == "assistant"]
    assert fresh == [t for _, _, _, t in rows[1:]]


def test_empty_table(spark):
    windows = chat.chat_windows(spark.createDataFrame([], TURNS), vocabulary())
    assert chat.conversation_digests(windows).collect() == []


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="\\<>|[]/INSTims_start_end\n", max_size=40), min_size=20, max_size=40))
def test_escapes_are_reversible(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e in frame.select("t", chat.escaped(F.col("t"))).collect():
        assert chat.unescaped(e) == t
        assert not any(c in e for c in chat.CONTROL)
