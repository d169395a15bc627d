"""Operators take ids of any type."""

import pytest

from lodestone.llm import chat, mixing, packing, simhash, token_counts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"a{k}", f"text number {k // 2} of a few words", "s" if k % 3 else None) for k in range(12)] + [(None, "x", "s")]
    return spark.createDataFrame(rows, "doc_id string, text string, source string").cache()


def test_simhash(docs):
    rows = {r.id: r.component_id for r in simhash.near_duplicate_classes(docs).collect()}
    assert len(rows) == 13 and all(rows[f"a{k}"] == min(f"a{k}", f"a{k ^ 1}") for k in range(12) if k < 10)
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert None in kept and len(kept) == len(set(kept)) < 13


def test_hot_and_cold_fingerprints_meet_their_classes(docs):
    plain = sorted(map(repr, simhash.near_duplicate_classes(docs).collect()))
    for share in (0.0, 0.1, 1.0):
        assert sorted(map(repr, simhash.near_duplicate_classes(docs, hot_share=share).collect())) == plain


def test_removed_ids_may_be_shuffled(docs):
    assert sorted(map(repr, simhash.keep_one(docs, broadcast_ids=0).collect())) == sorted(map(repr, simhash.keep_one(docs).collect()))


def test_token_counts_and_packing(docs):
    assert {r.id for r in token_counts.count_tokens(docs).collect()} == {r.doc_id for r in docs.collect()} == {r.doc_id for r in packing.pack(docs).collect()}


def test_mixing(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(mixing.sizes_of(docs)).collect()}
    got = [r.doc_id for r in mixed.collect()]
    assert {i: got.count(i) for i in taken} == taken


def test_mixing_of_repeated_rows(spark):
    """Rows alike in id and size are told apart by how many of them are taken; broadcast or not."""
    rows = [(1, "a b c", "s", k) for k in range(30)] + [(None, "a b", "t", k) for k in range(20)] + [(2, "x y z w", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    decided = mixing.mix(mixing.sizes_of(df)).collect()
    for most in (20_000, 0):
        got = mixing.mixed_documents(df, broadcast_sources=most).collect()
        for i in (1, None, 2):
            assert sum(r.doc_id == i for r in got) == sum(r.taken // r["size"] for r in decided if r.doc_id == i)
        assert max(got.count(r) for r in got) <= 2
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(mixing.sizes_of(df), most_sources=1)


def test_chat(spark):
    turns = spark.createDataFrame([("c", 0, "user", "hi"), ("c", 1, "assistant", "ho"), (None, 0, "user", "x")], "conv_id string, turn long, role string, text string")
    assert sorted((r.conv_id or "", r.n_turns, r.loss_chars) for r in chat.digests(chat.format_conversations(turns)).collect()) == [("", 1, 0), ("c", 2, 2)]
