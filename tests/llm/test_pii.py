import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii as P
from lodestone.llm.queries import op9_pii
from tests.conftest import SMALL

CARD = "4111 1111 1111 1111"


def brute(text):
    """The patterns as they are stated, by plain regular expressions."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])]
            if (13 <= len(d) <= 19 and sum(doubled) % 10 == 0) if kind == 2 else 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="0123456789.@+ -()ab%é\n", max_size=60))
def test_base_spans(text):
    assert P.base_spans(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "1.2.3.4", CARD, "+1 (222) 333-4444", " ", "x", ".", "@", "+", "9"]), max_size=14).map("".join))
def test_base_spans_side_by_side(text):
    assert P.base_spans(text) == brute(text)


def test_very_long_texts_take_linear_time():
    for unit in ("1", "a", "+1", "1.", "@", "a@", "1 ", "-", "a.", "+ "):
        P.nodes(unit * (400_000 // len(unit)))


def docs_with_repeats(spark):
    rows = []
    for k in range(200):
        number = f"{k:04d}"
        rows.append((k, f"call +1 (555) 12{number[0]}-{number} or write u{k}@mail.example now, from 10.0.0.{k % 256} card {CARD}"))
    rows.append((900, "my number is +1 (743) 555-3824 as said, so call 743-555-3824 today"))
    rows.append((901, "an order number 743-555-3824 and nothing else"))
    rows.append((902, "nothing to find here"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_ties_carry_labels_to_other_forms(spark):
    df = docs_with_repeats(spark)
    found = {r.id: (r.base, r.spans) for r in P.find(df).collect()}
    base, spans = found[900]
    assert len(base) == 1 and set(base) < set(spans)
    text = df.filter("doc_id = 900").first().text
    added = (set(spans) - set(base)).pop().split(":")
    assert added[0] == "phone" and text[int(added[1]) : int(added[2])] == "743-555-3824"
    assert found[901] == ([], []) == found[902]
    assert all(set(b) <= set(s) for b, s in found.values())
    clean = {r.doc_id: r.text for r in P.redact(df, n_chars=None).collect()}
    assert clean[900] == "my number is [PHONE] as said, so call [PHONE] today"
    assert clean[902] == "nothing to find here"
    assert clean[7] == "call [PHONE] or write [EMAIL] now, from [IP] card [CARD]"


def enumerated(w, labels, codes, keys, chained):
    """Marginals by summing over all labellings."""
    size = len(P.LABELS)
    unary = P.features(codes) @ w.node.T - 12 * P.unfit(codes)
    n = len(labels)
    total = np.zeros((n, size))
    free = [range(size) if y <= 0 else [y] for y in labels]
    for y in itertools.product(*free):
        e = sum(unary[i, y[i]] for i in range(n))
        e += sum(w.chain[y[i - 1], y[i]] if chained[i] else w.chain[0, y[i]] for i in range(n))
        e += sum(w.chain[y[i], 0] for i in range(n) if i + 1 == n or not chained[i + 1])
        e += sum(w.tie[y[i], y[j]] for i, j in P.ties(keys, labels))
        for i in range(n):
            total[i, y[i]] += np.exp(e)
    return total / total.sum(1, keepdims=True)


def random_weights(seed, tie=1.5):
    rng = np.random.default_rng(seed)
    size = len(P.LABELS)
    return P.Weights(rng.normal(size=(size, P.N_FEATURES)), np.where(P.ALLOWED, rng.normal(size=(size, size)), P.NEVER), tie * P._SAME + 0.5 * P._NONE)


CODES = [P.shape(x) for x in ("743-555-3824", "(743)", "4111111111111111", "1.2.3.4", "x@y.z", "+1")]


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_exact_on_a_tree(seed):
    w = random_weights(seed)
    for labels, keys, chained in (([0, 8, 0, 0], [0, 0, 0, 0], [0, 1, 1, 1]), ([0, 0, 0], [1, 2, 1], [0, 0, 1]), ([0, 7, 0], [3, 3, 0], [0, 0, 1])):
        codes = CODES[: len(labels)]
        got = P.Field(w).marginals(labels, codes, keys, chained, rounds=300)
        assert np.allclose(got, enumerated(w, labels, codes, keys, chained), atol=1e-3)


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_close_on_loops(seed):
    """Chains and ties that close loops: belief propagation is not exact there, but near and mostly of one mind."""
    w = random_weights(seed, 1.0)
    for labels, keys, chained in (([0, 0, 0, 0], [1, 2, 1, 2], [0, 1, 1, 1]), ([0, 0, 0, 7], [1, 1, 1, 1], [0, 1, 0, 0]), ([0, 0, 0, 0], [1, 1, 2, 2], [0, 1, 1, 1])):
        codes = CODES[: len(labels)]
        got, sure = P.Field(w).marginals(labels, codes, keys, chained), enumerated(w, labels, codes, keys, chained)
        assert np.abs(got - sure).max() < 0.25
        firm = sure.max(1) > 0.7
        assert (got.argmax(1) == sure.argmax(1))[firm].all()


def test_the_gradient_is_that_of_the_likelihood():
    """On trees, where belief propagation is exact: against differences of enumerated partition sums."""
    w = random_weights(5)
    labels, codes, keys, chained = (7, 8, 0), tuple(CODES[:3]), (0, 1, 1), (0, 1, 0)
    graph = P.Graph([(labels, codes, keys, chained)])
    stats = []
    for clamped in ("known", False):
        belief, sent = graph.propagate(w, graph.unary(w, clamped), rounds=50)
        stats.append(graph.expected(w, belief, sent, np.ones(3)))
    sure = enumerated(w, (0, 0, 0), codes, keys, chained)
    assert np.allclose(stats[1].node, sure.T @ P.features(codes), atol=1e-6)
    onehot = np.eye(len(P.LABELS))[list(labels)]
    assert np.allclose(stats[0].node, onehot.T @ P.features(codes), atol=1e-6)
    assert stats[0].tie[8, 0] == pytest.approx(1) and stats[1].tie.sum() == pytest.approx(1) and stats[0].chain.sum() == pytest.approx(5)


def sample_parts(rows):
    parts = Counter()
    for text in rows:
        n, _ = P.nodes(text)
        parts.update(p for _, p in P.components(n.labels, n.shapes, n.keys, n.chained))
    return parts


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [r["text"] for r in rows if r["doc_id"] % 2], [r["text"] for r in rows if not r["doc_id"] % 2]


def test_withheld_spans_are_found(texts):
    """Learnt on half of the documents; in the others every pattern's match is withheld, and what is added is held against it."""
    field = P.Field(P.fit(sample_parts(texts[0])))
    hit = wrong = missed = 0
    for text in texts[1]:
        found, base = P.nodes(text)
        blind = P.Nodes(found.starts, found.ends, [0] * len(found.labels), found.shapes, found.keys, found.chained)
        got = set(field.added(lambda a, b: text[a:b], blind)) - set(field.added(lambda a, b: text[a:b], found))
        hit, wrong, missed = hit + len(got & set(base)), wrong + len(got - set(base)), missed + len(set(base) - got)
    assert hit > 300 and hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_added_spans_of_the_table_are_explained(texts):
    """Every span the field adds is a number that a pattern swallowed together with its neighbour: a card by Luhn, or a whole phone."""
    field = P.Field(P.fit(sample_parts(texts[0] + texts[1])))
    added = []
    for text in texts[0] + texts[1]:
        found, base = P.nodes(text)
        for kind, a, b in field.added(lambda a, b: text[a:b], found):
            assert all(b <= x or y <= a for _, x, y in base)
            s = text[a:b]
            assert P.luhn(s) and len(s) == 16 if kind == 2 else re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", s)
            added.append(s)
    assert len(added) == 5


def test_numbers_written_in_other_ways(texts):
    field = P.Field(P.fit(sample_parts(texts[0])))
    for text, clean in (
        ("SO +1!! (743)!! 555-3824!! IT", "SO [PHONE]!! IT"),
        ("a | +1 | (743) | 555-3824 | b", "a | [PHONE] | b"),
        ("+1 (826) 555-4081 190.137.223.204", "[PHONE] [IP]"),
        ("4111111111111111 476159897740 x", "[CARD] 476159897740 x"),
        ("+1 (826) 555-4081 or 826 555 4081 or (555-4081)", "[PHONE] or [PHONE] or [PHONE]"),
        ("order 743-555-3824 of 2024-01-05, 3.5 kg at 12:30, token deadbeef0123456789abcdef", None),
        ("1787556152378721 and 476159897740", None),
    ):
        assert P.redacted(text, field) == (clean or text)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op9_pii(spark, SMALL).collect():
        spans = sorted(brute(texts[r.doc_id]))
        base = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in spans) for n in range(4)]
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "i"), (None, "a@b.c", 5, None), (2, "", 0, "i"), (3, "x@y.zz", 6, "i"), (3, "x@y.zz", 6, "i")], "doc_id long, text string, n_chars long, id string")
    got = sorted(((r.id or 0, len(r.base)) for r in P.find(df).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    out = P.redact(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "[EMAIL]", 7), (1, None, None), (2, "", 0), (3, "[EMAIL]", 7), (3, "[EMAIL]", 7)]
    assert P.find(df.limit(0)).count() == 0 == P.redact(df.limit(0)).count()


@pytest.mark.parametrize("others", [1, 10, 100, 1000])
@pytest.mark.parametrize("place", [0, 0.5, 1])
def test_every_mention_is_found_however_many(others, place):
    """One base span among many mentions of its number, with weights that prefer none by one nat."""
    size = len(P.LABELS)
    node = np.zeros((size, P.N_FEATURES))
    node[:, -1] = [1, -2, -2, -2, -2, -2, -2, 0, 0]
    field = P.Field(P.Weights(node, np.where(P.ALLOWED, 0.0, P.NEVER), 7.4 * P._SAME))
    mentions = ["743-555-3824"] * others
    mentions.insert(int(place * others), "+1 (743) 555-3824")
    text = " or ".join(mentions)
    assert len(P.base_spans(text)) == 1
    assert P.redacted(text, field) == " or ".join(["[PHONE]"] * (others + 1))


def test_every_mention_is_found_with_learnt_weights(spark):
    field = P.learn(P.find_nodes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache())
    for others in (1, 10, 100, 1000):
        text = " or ".join(["+1 (743) 555-3824", *["743-555-3824"] * others])
        assert P.redacted(text, field) == " or ".join(["[PHONE]"] * (others + 1))


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a1", "x@y.zz"), (None, "b")], "doc_id string, text string")
    assert sorted((r.id or "", len(r.base)) for r in P.find(df).collect()) == [("", 0), ("a1", 1)]
