import hashlib
import random

import pytest

from lodestone.llm.chat import START, Template, chat_digests, chat_segments

PIECES = ["\\", "\\\\", "### User: ", "### Assistant:", "</turn>", " </turn>\n", "\n", "### Role ", "###", " ", "é", "ok", "system", "### System: x"]


def some(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))


def test_texts_and_roles_come_back():
    rng, t = random.Random(1), Template()
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "### Role \n", "a\nb", "\\"]), some(rng)) for _ in range(rng.randrange(4))]
        formatted = "".join(piece for turn in turns for piece, _ in t.segments(*turn))
        assert t.read(formatted) == turns


def test_machine():
    t = Template()
    for roles, state in [(["user", "assistant"], "assistant"), (["system", "user"], "user"), (["assistant"], None), (["user", "user"], None), (["user", None, "assistant"], None)]:
        s = START
        for r in roles:
            s = t.step(s, r)
        assert s == state


def test_digests_equal_plain_form(spark):
    rng = random.Random(2)
    rows = [(c if c else None, i if i % 6 else None, rng.choice(["user", "assistant", None, "tool"]), rng.choice([None, some(rng), some(rng)]), 1) for c in range(40) for i in range(rng.randrange(1, 8))]
    rows += [(3, 1, "user", "same", 1)] * 3 + [(99, i, ("user", "assistant")[i % 2], f"t{i}", 1) for i in range(3000)] + [(100, 0, "user", "x" * 2_000_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int").repartition(7)
    got = {r.conv_id: r for r in chat_digests(chat_segments(df)).collect()}
    order = lambda v: (v is not None, v)
    t = Template()
    for conv in {r[0] for r in rows}:
        own = sorted(((i, r, x or "") for c, i, r, x, _ in rows if c == conv), key=lambda v: (order(v[0]) if v[0] is not None else (False, 0), (v[1] is not None, (v[1] or "").encode()), v[2].encode()))
        turns = [(r or "", x) for _, r, x in own]
        loss = "".join(x for r, x in turns if r == "assistant")
        state = START
        for r, _ in turns:
            state = t.step(state, r or None)
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                sum(len(p) for turn in turns for p, _ in t.segments(*turn)), state == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars, r.valid) == want, conv
    assert not got


def test_empty_table(spark):
    assert chat_digests(chat_segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("loss", [("assistant",), ("user", "assistant")])
def test_loss_flags(loss):
    assert [f for _, f in Template(loss=loss).segments("user", "x")] == [False, "user" in loss, False]
