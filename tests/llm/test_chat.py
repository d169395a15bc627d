import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chat as C
from lodestone.llm.queries import ORACLE, op4_chat


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "s>", "|", "/", "a", "\n", "é"]), max_size=8).map("".join))
def test_escape(text):
    out = C.escape(text)
    assert C.unescape(out) == text
    assert not any(c in out for c in C.CONTROL)


def test_query_equals_its_sql(same):
    same(op4_chat, ORACLE["op4_chat"])


def test_masks_and_tokens(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes <|end|>"), (1, 2, "assistant", "more"), (2, 0, "assistant", "")]
    out = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "nth").collect()
    bpe = C.ByteBpe()
    stream = [i for r in out if r.conv_id == 1 for i in r.ids]
    assert sum(i >= C.FIRST_RESERVED for i in stream) == 9  # three marks a turn, none from the texts
    starts = [r.start for r in out if r.conv_id == 1]
    assert starts == [0, len(out[0].ids), len(out[0].ids) + len(out[1].ids)]
    assert [bpe.decode_bytes(stream[r.loss_start : r.loss_end]).decode() for r in out[:3]] == ["", C.escape("yes <|end|>"), "more"]
    assert out[3].loss_start == out[3].loss_end


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a", "x"), (None, 0, None, None, None), (5, None, "assistant", "b", "y"), (5, None, "assistant", "b", "y"), (6, 1, "assistant", "é漢 " * 30_000, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in C.digests(C.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 5: 2, 6: 1}
    assert got[None].turns_sha256 == hashlib.sha256(b"\n\nuser\na\n").hexdigest()
    assert (got[5].loss_chars, got[5].loss_sha256) == (2, hashlib.sha256(b"bb").hexdigest())
    assert got[6].loss_sha256 == hashlib.sha256(("é漢 " * 30_000).encode()).hexdigest()
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0


def test_long_conversation(spark):
    df = spark.range(5000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    row = C.digests(C.format_conversations(df)).first()
    whole = "".join(f"{'user' if k % 2 == 0 else 'assistant'}\nturn {k}\n" for k in range(5000))
    assert (row.n_turns, row.turns_sha256) == (5000, hashlib.sha256(whole.encode()).hexdigest())


def test_damaged_tokens_are_refused():
    import numpy as np

    with pytest.raises(ValueError):
        C.Reader(C.ByteBpe()).add(np.array([C.RESERVED[C.TURN], 5, 6]), 0, 0, 0)
