import random

import pytest
from tokenizers import Tokenizer, models

from lodestone.llm import token_counts as C
from lodestone.llm.queries import op5_tokens
from tests.conftest import SMALL


def exact(pieces):
    """The tokenizer library's unigram model over the same pieces, with byte fallback."""
    least = min(pieces.values())
    return Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items(), *((f"<0x{i:02X}>", least) for i in range(256))], 0, True))


def length(tokenizer, text):
    return len(tokenizer.encode(C.SPACE + text.replace(" ", C.SPACE), add_special_tokens=False).ids) if text else 0


def test_query_against_the_exact_tokenizer(spark):
    tokenizer = exact(C.sentencepiece_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in op5_tokens(spark, SMALL).collect()} == {i: length(tokenizer, t) for i, t in texts.items()}


def test_words_are_counted_as_in_the_whole_text():
    pieces = C.sentencepiece_vocabulary()
    each, tokenizer = C.Counter(pieces), exact(pieces)
    assert each.by_word
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("ab etaoin  \n\té漢😀▁<0xA>") for _ in range(rng.randint(1, 30)))
        assert each.count(text)[0] == length(tokenizer, text) == each.path(C.SPACE + text.replace(" ", C.SPACE))[0], repr(text)


def test_ties_on_small_vocabularies():
    rng = random.Random(2)
    for _ in range(200):
        pieces = {"".join(rng.choice(f"ab{C.SPACE}") for _ in range(rng.randint(1, 4))): -float(rng.randint(0, 4)) / rng.choice([1, 2]) for _ in range(12)}
        each, tokenizer = C.Counter(pieces), exact(pieces)
        for _ in range(20):
            text = "".join(rng.choice("abc \n") for _ in range(rng.randint(1, 20)))
            assert each.count(text)[0] == length(tokenizer, text), (text, pieces)


def test_memory_is_bounded():
    each = C.Counter({C.SPACE: -1.0, "a": -2.0, "b": -3.0}, remember=3)
    for k in range(50):
        each.count("a" * k + " " + "b" * k)
        assert len(each.known) <= 3


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "x", "b"), (2, "", None), (3, "ab " * 50_000, "c"), (3, "x" * 100_000, "c")], "doc_id long, text string, id string")
    got = sorted((r.id or 0, r.n_tokens) for r in C.count_tokens(df).collect())
    assert [i for i, _ in got] == [0, 1, 2, 3, 3] and got[1][1] == got[2][1] == 0 < got[0][1]
    assert C.count_tokens(df.limit(0)).count() == 0
    with pytest.raises(Exception):
        C.Counter({})
