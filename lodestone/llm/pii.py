"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from four patterns with checks; they are evidence and stay as
they are.  The field is over the words of a document.  Words without a digit or
an @ can be none of the four kinds: those with letters have the label *none*
for certain, so that the chain falls into independent parts there, and those of
signs alone (bars, dashes) separate words without ending a chain.  Every other
word is a node whose label is none or the beginning or inside of a kind.
Neighbours are chained; distant words that are repeated or similar (the same
address ignoring case, numbers with the same last seven digits, where a number
may be spread over several words) share a potential, so that evidence for one
mention is evidence for all.  Each node is tied to the nearest earlier one of
its key and, if no pattern matched it, to the nearest marked ones on both
sides, so the field is linear in the document.  Marginals come from loopy
belief propagation, run until no message changes.

All weights (word shapes by label, transitions, ties) are learnt together by
following the gradient of the likelihood that belief propagation gives, from
the base spans of a sample of ``train_documents`` documents with nodes, taken
by a hash.  Words whose label the patterns leave open are hidden there: those
similar to a marked word, and those in a match that was dropped for holding
more digits than one number can have (two numbers side by side).

Defined results: a null text counts as empty; nulls in other columns are
passed through; ids may be of any type; repeated rows are found each by itself;
an empty table gives an empty result; offsets are code points of the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

KINDS = ("email", "ip", "card", "phone")
#: Beginning and inside of each kind, after none.
LABELS = ("none", *(f"{place}-{k}" for k in KINDS for place in "BI"))
KIND_OF = np.array([-1, *(k for k in range(len(KINDS)) for _ in "BI")])
#: The label of a word that the patterns leave open.
OPEN = -1
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: A word with a digit or an @; each character is read once.
_NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_LETTER = re.compile(r"[^\W_]")
_NUMERIC = re.compile(r"[0-9+().-]*")
_FOUR = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_ADDRESS = re.compile(r"[^@]+@[^@.]+(?:\.[^@.]+)+")
_OUTER = "\"'`<>[]{}|,;:!?*_=/\\~^&$#"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, in linear time: each @ is tried once with what stands before it."""
    found, start, at = [], 0, text.find("@")
    while at >= 0:
        before = text[start:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        start = at + 1
        if local and (m := _DOMAIN.match(text, at + 1)):
            found.append((at - local, m.end()))
            start = m.end()
        at = text.find("@", start)
    return found


def patterns(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (kind, start, end) in order of kind and start, kinds as in KINDS from 0; and matches dropped for too many digits."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    dropped = []
    if _DIGIT.search(text) is None:
        return out, dropped
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m[0])
            if len(d) > 19:
                dropped.append(m.span())
            elif len(d) >= 13 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(digits_of(m[0]))
            if n > 15:
                dropped.append(m.span())
            elif n >= 9:
                out.append((3, *m.span()))
    return out, dropped


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return patterns(text)[0]


def core(text: str, a: int, b: int) -> tuple[int, int]:
    """The word's place without signs around it; signs alone stay."""
    s = text[a:b]
    left = s.lstrip(_OUTER + ".-")
    s2 = left.rstrip(_OUTER + ".-")
    if s2[:1] == "(" and ")" not in s2:
        s2 = s2[1:]
    if s2[-1:] == ")" and "(" not in s2:
        s2 = s2[:-1].rstrip(_OUTER + ".-")
    if not s2:
        return a, b
    start = a + s.index(s2, len(s) - len(left))
    return start, start + len(s2)


_BUCKETS = (0, 1, 2, 3, 4, 5, 7, 8, 10, 11, 13, 16, 17, 20)
N_FLAGS = 9
N_FEATURES = len(_BUCKETS) + N_FLAGS + 1
#: The code of a word whose shape is hidden.
HIDDEN = 1 << 20


def shape(s: str) -> int:
    """Feature code of a word's core: how many digits it has, and signs, as bits."""
    d = digits_of(s)
    n = len(d)
    size = sum(n >= b for b in _BUCKETS) - 1
    numeric = _NUMERIC.fullmatch(s) is not None
    four = _FOUR.fullmatch(s) is not None and all(int(p) < 256 for p in s.split("."))
    flags = (13 <= n <= 19 and luhn(d), "@" in s, _ADDRESS.fullmatch(s) is not None, s[:1] == "+", "(" in s, "-" in s, four, "." in s and not four, numeric)
    return size | sum(1 << (4 + k) for k, f in enumerate(flags) if f)


def features(codes: list[int]) -> np.ndarray:
    c = np.asarray(codes, np.int64)
    x = np.zeros((len(c), N_FEATURES))
    x[np.arange(len(c)), c & 15] = 1
    for k in range(N_FLAGS):
        x[:, len(_BUCKETS) + k] = c >> (4 + k) & 1
    x[c == HIDDEN] = 0
    x[:, -1] = 1
    return x


def unfit(codes: list[int]) -> np.ndarray:
    """1 for labels that a word of that shape can hardly have: addresses without @, IPs without points, numbers with @."""
    c = np.asarray(codes, np.int64)
    at, point = c >> 5 & 1 == 1, (c >> 10 & 1) + (c >> 11 & 1) > 0
    x = np.zeros((len(c), len(LABELS)))
    for kind, no in enumerate((~at, ~point | at, at, at)):
        x[no & (c != HIDDEN), 1 + 2 * kind : 3 + 2 * kind] = 1
    return x


@dataclass(frozen=True)
class Nodes:
    """Words that may be personal data: places, labels by the patterns, shapes, keys (0: none), and whether chained to the one before."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    shapes: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    chained: list[int] = field(default_factory=list)


def _key(s: str) -> int:
    return (xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 1) >> 1) | 1


def nodes(text: str | None) -> tuple[Nodes, list[tuple[int, int, int]]]:
    """The field's words and the base spans of a text."""
    out = Nodes()
    if not text or ("@" not in text and _DIGIT.search(text) is None):
        return out, []
    base, dropped = patterns(text)
    words = [m.span() for m in _NODE.finditer(text)]
    labels = [0] * len(words)
    for kind, spans in [*((k, [(a, b) for n, a, b in base if n == k]) for k in range(len(KINDS))), (None, sorted(dropped))]:
        at = 0
        for a, b in spans:
            while at < len(words) and words[at][1] <= a:
                at += 1
            first, i = True, at
            while i < len(words) and words[i][0] < b:
                if not labels[i]:
                    labels[i] = OPEN if kind is None else 1 + 2 * kind + (not first)
                    first = False
                else:
                    first = True
                i += 1
    run, before = "", 0
    for i, (a, b) in enumerate(words):
        chained = i > 0 and _LETTER.search(text, before, a) is None
        before = b
        a, b = core(text, a, b)
        s = text[a:b]
        code = shape(s)
        numeric = bool(code >> 4 + N_FLAGS - 1 & 1)
        run = (run if chained and s[:1] != "+" else "") + digits_of(s) if numeric else ""
        run = run[-7:]
        key = _key(s.lower()) if "@" in s else _key(run) if len(run) == 7 else 0
        for column, value in zip((out.starts, out.ends, out.shapes, out.keys, out.chained), (a, b, code, key, int(chained))):
            column.append(value)
    marked = {k for k, label in zip(out.keys, labels) if label > 0 and k}
    out.labels.extend(OPEN if not label and k in marked else label for label, k in zip(labels, out.keys))
    return out, base


def ties(keys: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """To the nearest earlier node of the same key, and of each unmarked node to the nearest marked ones on both sides."""
    out, last = [], {}
    for i, k in enumerate(keys):
        if k:
            if k in last:
                out.append((last[k], i))
            last[k] = i
    for order in (range(len(keys)), range(len(keys) - 1, -1, -1)):
        marked: dict[int, int] = {}
        for i in order:
            if labels[i] > 0:
                marked[keys[i]] = i
            elif keys[i] and keys[i] in marked:
                out.append((min(i, marked[keys[i]]), max(i, marked[keys[i]])))
    return list(dict.fromkeys(out))


#: Components of a field: labels, shapes, keys numbered from 1 in order, chained.
Component = tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...], tuple[int, ...]]


def components(labels: list[int], shapes: list[int], keys: list[int], chained: list[int]) -> list[tuple[list[int], Component]]:
    """The independent parts of a document's field: their nodes, and their form."""
    up = list(range(len(keys)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    last: dict[int, int] = {}
    for i, k in enumerate(keys):
        if chained[i]:
            up[root(i)] = root(i - 1)
        if k:
            if k in last:
                up[root(i)] = root(last[k])
            last[k] = i
    parts: dict[int, list[int]] = {}
    for i in range(len(keys)):
        parts.setdefault(root(i), []).append(i)
    out = []
    for own in parts.values():
        number: dict[int, int] = {0: 0}
        form = tuple(number.setdefault(keys[i], len(number)) for i in own)
        out.append((own, (tuple(labels[i] for i in own), tuple(shapes[i] for i in own), form, tuple(chained[i] for i in own))))
    return out


#: Logarithms: of transitions that can't be, and of labels against evidence, which no number of ties outweighs.
NEVER, CERTAIN = -40.0, -1e9


def _allowed() -> np.ndarray:
    """Which label may follow which: an inside only its own kind's beginning or inside."""
    n = len(LABELS)
    out = np.ones((n, n), bool)
    for y in range(n):
        for z in range(2, n, 2):
            out[y, z] = KIND_OF[y] == KIND_OF[z]
    return out


ALLOWED = _allowed()
_SAME = (KIND_OF[:, None] == KIND_OF[None, :]) & (KIND_OF[:, None] >= 0)
_NONE = (KIND_OF[:, None] < 0) & (KIND_OF[None, :] < 0)


class Graph:
    """Belief propagation over one or many components at once, in place of their sum."""

    def __init__(self, parts: list[Component]):
        sizes = [len(p[0]) for p in parts]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if parts else np.empty(0, np.int64)
        self.n = sum(sizes)
        self.owner = np.repeat(np.arange(len(parts)), sizes)
        self.labels = np.array([y for p in parts for y in p[0]], np.int64)
        codes = [c for p in parts for c in p[1]]
        self.x, self.unfit = features(codes), unfit(codes)
        chained = np.array([c for p in parts for c in p[3]], bool)
        right = np.flatnonzero(chained)
        bound = np.array([(f + i, f + j) for f, p in zip(first.tolist(), parts) for i, j in ties(p[2], p[0])], np.int64).reshape(-1, 2)
        self.starts = ~chained
        self.ends = ~np.concatenate((chained[1:], [False]))
        a, b = np.concatenate((right - 1, bound[:, 0])), np.concatenate((right, bound[:, 1]))
        self.chains, self.edges = len(right), len(a)
        self.source, self.goal = np.concatenate((a, b)), np.concatenate((b, a))
        self.back = np.concatenate((np.arange(self.edges) + self.edges, np.arange(self.edges)))

    def sums(self, messages: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.goal, messages[:, k], self.n) for k in range(len(LABELS))], axis=1)

    def unary(self, w: Weights, clamped: bool) -> np.ndarray:
        u = self.x @ w.node.T - 12 * self.unfit
        u[self.starts] += w.chain[0]
        u[self.ends] += w.chain[:, 0]
        if clamped:
            known = self.labels >= (1 if clamped == "marked" else 0)
            u[known] += np.where(np.arange(len(LABELS)) == self.labels[known][:, None], 0.0, CERTAIN)
        return u

    def propagate(self, w: Weights, unary: np.ndarray, sent: np.ndarray | None = None, rounds: int = 10, damping: float = 0.0, until: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(beliefs, messages), both logarithms; all messages are renewed each round."""
        sent = np.zeros((2 * self.edges, len(LABELS))) if sent is None else sent
        chain, tie, e, c = np.exp(w.chain), np.exp(w.tie), self.edges, self.chains
        belief = unary + self.sums(sent)
        for _ in range(rounds if self.edges else 0):
            inward = belief[self.source] - sent[self.back]
            inward = np.exp(inward - inward.max(axis=1, keepdims=True))
            new = np.empty_like(sent)
            new[:c], new[c:e] = inward[:c] @ chain, inward[c:e] @ tie
            new[e : e + c], new[e + c :] = inward[e : e + c] @ chain.T, inward[e + c :] @ tie.T
            new = np.log(np.maximum(new, 1e-300))
            new -= new.max(axis=1, keepdims=True)
            new = damping * sent + (1 - damping) * new
            change = np.abs(new - sent).max()
            sent = new
            belief = unary + self.sums(sent)
            if change < until:
                break
        return belief, sent

    def expected(self, w: Weights, belief: np.ndarray, sent: np.ndarray, weight: np.ndarray) -> Weights:
        """Weighted expectations of what the weights belong to."""
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p *= (weight / p.sum(axis=1))[:, None]
        chain = np.zeros_like(w.chain)
        chain[0] += p[self.starts].sum(axis=0)
        chain[:, 0] += p[self.ends].sum(axis=0)
        tie = np.zeros_like(w.tie)
        e, c = self.edges, self.chains
        left = belief[self.source[:e]] - sent[e:]
        right = belief[self.goal[:e]] - sent[:e]
        left, right = (np.exp(x - x.max(axis=1, keepdims=True)) for x in (left, right))
        for part, pair, into in ((slice(0, c), np.exp(w.chain), chain), (slice(c, e), np.exp(w.tie), tie)):
            total = np.einsum("ei,ij,ej->e", left[part], pair, right[part])
            scale = weight[self.source[:e][part]] / np.maximum(total, 1e-300)
            into += pair * ((left[part] * scale[:, None]).T @ right[part])
        return Weights(p.T @ self.x, chain, tie)


@dataclass(frozen=True)
class Weights:
    """Word shapes by label, transitions, and ties."""

    node: np.ndarray
    chain: np.ndarray
    tie: np.ndarray

    @classmethod
    def none(cls) -> Weights:
        """Without anything learnt every word is none."""
        n = len(LABELS)
        node = np.zeros((n, N_FEATURES))
        node[0, -1] = 5
        return cls(node, np.where(ALLOWED, 0.0, NEVER), np.zeros((n, n)))


@dataclass(frozen=True)
class Field:
    """The learnt weights, and how probable a kind has to be."""

    weights: Weights = field(default_factory=Weights.none)
    threshold: float = 0.7

    def marginals(self, labels: list[int], shapes: list[int], keys: list[int], chained: list[int], rounds: int | None = None) -> np.ndarray:
        """Label probabilities of each node by loopy sum-product belief propagation, words marked by patterns given.

        It runs until no message changes; the limit of rounds grows with the document.
        """
        graph = Graph([(tuple(labels), tuple(shapes), tuple(keys), tuple(chained))])
        belief, _ = graph.propagate(self.weights, graph.unary(self.weights, "marked"), rounds=30 + 4 * len(labels) if rounds is None else rounds, damping=0.3, until=1e-5)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def decided(self, found: Nodes, known: dict | None = None) -> list[int]:
        """The label of each node: the patterns', or the field's where a kind is probable enough."""
        out = [max(y, 0) for y in found.labels]
        known = {} if known is None else known
        for own, part in components(found.labels, found.shapes, found.keys, found.chained):
            if all(y > 0 for y in part[0]):
                continue
            got = known.get(part)
            if got is None:
                p = self.marginals(*part)
                kinds = np.stack([p[:, 1 + 2 * k] + p[:, 2 + 2 * k] for k in range(len(KINDS))], axis=1)
                best = kinds.argmax(axis=1)
                inside = p[np.arange(len(p)), 2 + 2 * best] > p[np.arange(len(p)), 1 + 2 * best]
                got = np.where(kinds.max(axis=1) >= self.threshold, 1 + 2 * best + inside, 0).tolist()
                if len(known) >= 100_000:
                    known.clear()
                if len(own) <= 64:
                    known[part] = got
            for i, y in zip(own, got):
                if found.labels[i] <= 0:
                    out[i] = y
        return out

    def added(self, text_of, found: Nodes, known: dict | None = None) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the spans that the patterns don't have, by start."""
        out: list[list[int]] = []
        open_ = False
        for i, y in enumerate(self.decided(found, known)):
            if not y or found.labels[i] > 0:
                open_ = False
                continue
            kind = (y - 1) // 2
            if open_ and found.chained[i] and y % 2 == 0 and out[-1][0] == kind:
                out[-1][2] = found.ends[i]
            else:
                out.append([kind, found.starts[i], found.ends[i]])
            open_ = True
        return [(k, a, b) for k, a, b in out if plausible(k, text_of(a, b))]


def plausible(kind: int, s: str) -> bool:
    """Whether a span of the field can be of its kind at all."""
    n = len(digits_of(s))
    return (_ADDRESS.fullmatch(s) is not None, s.count(".") >= 3 and n >= 4, 13 <= n <= 19, 7 <= n <= 15)[kind]


_ARRAYS = ("starts", "ends", "labels", "shapes", "keys", "chained")
_FOUND = T.StructType([*(T.StructField(n, T.ArrayType(T.LongType())) for n in _ARRAYS), T.StructField("base", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.StringType()))])


def _find_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        per = [nodes(x) for x in texts]
        columns = [pa.array([getattr(n, name) for n, _ in per], kind) for name in _ARRAYS]
        base = pa.array([[v for span in spans for v in span] for _, spans in per], kind)
        words = pa.array([[x[a:b] for a, b in zip(n.starts, n.ends)] for (n, _), x in zip(per, texts)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, base, words], names=["id", *_FOUND.names])


def find_nodes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, starts, ends, labels, shapes, keys, chained, base, words) of every row; base holds kind, start, end of each base span."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), *_FOUND.fields])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(_find_nodes, schema)


def with_hidden_shapes(parts: dict[Component, int]) -> dict[Component, int]:
    """``parts`` and, of those with ties, copies in which every other word of a key hides its shape.

    Where a word's own shape says enough, ties have nothing to explain; hidden
    words can only be told by those they are tied to.
    """
    out = Counter(parts)
    for (labels, shapes, keys, chained), n in parts.items():
        for turn in (0, 1):
            seen: Counter = Counter()
            hidden = list(shapes)
            for i, k in enumerate(keys):
                if k and keys.count(k) > 1:
                    seen[k] += 1
                    if seen[k] % 2 == turn:
                        hidden[i] = HIDDEN
            if HIDDEN in hidden:
                out[labels, tuple(hidden), keys, chained] += n
    return out


def fit(parts: dict[Component, int], steps: int = 250, rate: float = 0.1, ridge: float = 2e-4, tie: tuple[float, float] = (4.0, 1.0)) -> Weights:
    """Weights that make the labels of components, each seen so often, likely.

    The gradient is that of the likelihood by belief propagation: expectations
    given the known labels less those given none.  Messages of a step start
    from those of the step before.  ``tie`` is where the ties' weights (of one
    kind, of none) lie as long as the data say nothing about them.
    """
    parts = with_hidden_shapes(parts)
    w = Weights.none()
    if not any(y > 0 for p in parts for y in p[0]):
        return w
    graph = Graph(list(parts))
    weight = np.array(list(parts.values()), float)[graph.owner]
    total = weight.sum()
    prior = [np.zeros_like(w.node), np.zeros_like(w.chain), np.array(tie)]
    params = [p.copy() for p in prior]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    messages: dict = {}
    for step in range(1, steps + 1):
        w = Weights(params[0], np.where(ALLOWED, params[1], NEVER), params[2][0] * _SAME + params[2][1] * _NONE)
        sums = []
        for clamped in ("known", False):
            belief, messages[clamped] = graph.propagate(w, graph.unary(w, clamped), messages.get(clamped), 12 if step == 1 else 4, 0.3)
            sums.append(graph.expected(w, belief, messages[clamped], weight))
        up, down = sums
        bound = up.tie - down.tie
        grads = [up.node - down.node, np.where(ALLOWED, up.chain - down.chain, 0.0), np.array([bound[_SAME].sum(), bound[_NONE].sum()])]
        for k, g in enumerate(grads):
            g = g / total - ridge * (params[k] - prior[k])
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Weights(params[0], np.where(ALLOWED, params[1], NEVER), params[2][0] * _SAME + params[2][1] * _NONE)


def learn(found: DataFrame, train_documents: int = 4000, train_words: int = 64, threshold: float = 0.7) -> Field:
    """The field's weights from stored nodes.

    Learnt from at most ``train_documents`` documents that have nodes, at most
    ``train_words`` each, taken by a hash of id and place, so that all are
    alike; that bounds what reaches the driver.
    """
    some = found.filter(F.size("labels").between(1, train_words)).select("labels", "shapes", "keys", "chained", F.xxhash64(F.col("id").cast("string"), "starts", "keys").alias("h"))
    parts: Counter = Counter()
    for r in some.orderBy("h").limit(train_documents).drop("h").collect():
        parts.update(p for _, p in components(*r))
    return Field(fit(parts), threshold)


def _as_text(spans: list[tuple[int, int, int]]) -> list[str]:
    return [f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)]


def _spans(base: list[int]) -> list[tuple[int, int, int]]:
    return list(zip(base[::3], base[1::3], base[2::3]))


def spans_of(found: DataFrame, model: Field) -> DataFrame:
    """(id, base, spans): arrays of ``kind:start:end`` by kind and start."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*_ARRAYS, "base", "words")]
            base, spans = [], []
            for *arrays, own, words in zip(*lists):
                marked = _spans(own)
                base.append(_as_text(marked))
                if arrays[0]:
                    n = Nodes(*arrays)
                    marked = marked + model.added(_pieces(n, words), n, known)
                spans.append(_as_text(marked))
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, text), pa.array(spans, text)], names=["id", "base", "spans"])

    strings = T.ArrayType(T.StringType())
    return found.mapInArrow(decode, T.StructType([found.schema["id"], T.StructField("base", strings), T.StructField("spans", strings)]))


def _pieces(n: Nodes, words: list[str]):
    """The text between two places as far as nodes hold it, which is all that ``plausible`` looks at."""
    at = {a: i for i, a in enumerate(n.starts)}
    end = {b: i for i, b in enumerate(n.ends)}
    return lambda a, b: " ".join(words[at[a] : end[b] + 1])


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, spans) of every row, the field learnt from a sample of them."""
    found = cut(find_nodes(df, key, text), "nodes")
    return spans_of(found, learn(found))


def redacted(text: str | None, model: Field, known: dict | None = None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    found, base = nodes(text)
    if not found.starts:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, k in sorted((a, b, k) for k, a, b in base + model.added(lambda a, b: text[a:b], found, known)):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data in its text replaced, and ``n_chars`` counted anew."""
    model = learn(cut(find_nodes(df, key, text).filter("size(starts) > 0"), "nodes"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in slices(batches):
            at = batch.schema.get_field_index(text)
            clean = [redacted(x, model, known) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            if n_chars and (k := batch.schema.get_field_index(n_chars)) >= 0:
                columns[k] = pa.array([None if x is None else len(x) for x in clean], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(apply, df.schema)
