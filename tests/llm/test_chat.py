import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm.chat import Codec, Template, chat_digests, format_chats

PIECES = ["\\", "\\\\", "### ", "User:", "### Assistant: ", "### Role: ", "</turn>", "<", "/turn>", "\n", "a", "é", "#"]
SAID = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), SAID), SAID), max_size=5))
def test_reading_gives_the_turns_back(turns):
    codec = Codec(Template())
    parts = [p for role, text in turns for p in codec.segments(role, text)]
    assert codec.read("".join(t for t, _ in parts)) == turns
    assert [codec.unescape(t) for t, loss in parts if loss] == [t for r, t in turns if r == "assistant"]
    assert all(mark not in codec.escape(text) for _, text in turns for mark in codec.template.control())


def test_states_and_odd_rows(spark):
    rows = [
        (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (2, 1, "assistant", "early"), (2, 2, "user", None), (3, 2, "user", "b"),
        (3, 1, "system", "a"), (None, 1, None, "lost"), (4, None, "user", "q"), (4, 5, "assistant", "x" * 300_000), (5, 1, "user", "u"),
        (5, 1, "user", "u"),
    ]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = {r.conv_id: r for r in chat_digests(format_chats(turns)).collect()}
    assert {k: (r.n_turns, r.accepted) for k, r in made.items()} == {
        1: (2, True), 2: (2, False), 3: (2, False), None: (1, False), 4: (2, True), 5: (2, False),
    }
    assert made[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
    assert made[4].loss_chars == 300_000 and made[2].loss_sha256 == hashlib.sha256(b"early").hexdigest()
    assert made[3].turns_sha256 == hashlib.sha256(b"system\na\nuser\nb\n").hexdigest()
    assert chat_digests(format_chats(turns.where("false"))).count() == 0


def test_long_conversations_across_batches(spark):
    turns = spark.range(25_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "string(id) AS text")
    (row,) = chat_digests(format_chats(turns)).collect()
    want = "".join(f"{'user' if k % 2 == 0 else 'assistant'}\n{k}\n" for k in range(25_000))
    assert (row.n_turns, row.accepted, row.turns_sha256) == (25_000, True, hashlib.sha256(want.encode()).hexdigest())
