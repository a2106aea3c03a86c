import hashlib
import random

from pyspark.sql import functions as F

from seepage.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segments string, valid int"


def hostile(rng):
    bits = ["\\", "[", "<", "[INST] ", " [/INST]", "</s>", "<s>", "<<SYS>>\n", "\n<</SYS>>\n", "\\b", "\\l", "\\\\", "[ROLE]", "[/TURN]", "word", " ", "\n", "é", "😀", "$1", "\\E", "\\Q"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))


def rows(seed):
    rng = random.Random(seed)
    out = []
    for c in range(60):
        for t in range(rng.randrange(1, 8)):
            role = rng.choice(["system", "user", "assistant", "tool<x>", None]) if c % 3 == 0 else ("user", "assistant")[t % 2]
            out.append((c, t, role, None if rng.random() < 0.05 else hostile(rng), "s", 1))
    out += [(None, 0, "user", "nameless", "s", 1), (7000, None, "user", "no turn", "s", 1), (7000, 0, "assistant", "x", "s", 1), (7001, 0, "user", "tie", "s", 1), (7001, 0, "user", "tie", "s", 1), (7002, 0, "user", "long [" * 20_000, "s", 1)]
    rng.shuffle(out)
    return out


def valid(roles):
    state = "start"
    for r in roles:
        state = chat.INSTRUCT.transitions.get((state, r))
        if state is None:
            return False
    return True


def test_digests_read_back_from_the_output(spark):
    r = rows(1)
    got = {x.conv_id: x for x in chat.chat_digests(spark.createDataFrame(r, SCHEMA)).collect()}
    by = {}
    for c, t, role, text, *_ in r:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        x = got[c]
        told = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x.valid == valid([role for *_, role, _ in turns])


def test_bad_turn_and_only_valid(spark):
    r = [(1, 0, "user", "a", "", 0), (1, 1, "user", "b", "", 0), (1, 2, "assistant", "c", "", 0), (2, 0, "user", "a", "", 0), (3, 0, "assistant", "a", "", 0)]
    out = {x.conv_id: (x.valid, x.bad_turn) for x in chat.format_chats(spark.createDataFrame(r, SCHEMA)).collect()}
    assert out == {1: (False, 1), 2: (True, None), 3: (False, 0)}
    assert [x.conv_id for x in chat.format_chats(spark.createDataFrame(r, SCHEMA), only_valid=True).collect()] == [2]


def test_loss_segments_hold_no_control_string(spark):
    out = chat.format_chats(spark.createDataFrame(rows(2), SCHEMA)).select(F.explode("segments").alias("s")).select("s.*").collect()
    controls = chat.INSTRUCT.controls()
    assert any(s.loss for s in out)
    assert not any(c in s.text for s in out if s.body for c in controls)
    assert all(s.body for s in out if s.loss)


def test_known_form(spark):
    r = spark.createDataFrame([(1, 1, "assistant", "yes", "", 0), (1, 0, "user", "ok?", "", 0)], SCHEMA)
    x = chat.read_chats(chat.format_chats(r)).collect()[0]
    assert x.formatted == "[INST] ok? [/INST]<s>yes</s>"
    assert [(s.text, s.loss) for s in x.segments if s.loss] == [("yes", True)]


def test_empty(spark):
    assert chat.chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0
