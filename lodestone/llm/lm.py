"""Deleted interpolation: a bigram model scored over the corpus it is learnt from.

A token's probability given the one before is a mixture of maximum-likelihood
estimates: of the pair, of the token, and a uniform floor.  The mixture weights
depend on how often the context was seen (a bucket per power of two) and are
learnt by expectation-maximisation on a fold of the training documents whose
counts are left out ("deleted") meanwhile; the final counts are those of all
training documents.

Counts are exchanged by blocks.  Documents are gathered where they are read
into chunks of about ``chunk_bytes`` of text, written once, compressed, and
read for every later step; the fold makes chunks of its own, which alone are
read for the mixture weights.  A chunk sends its distinct 64-bit hashes of
tokens and pairs, sorted, with its own counts, cut into key ranges.  A range's
counts are summed over all chunks, as 64-bit numbers, and sent back in the
order of the chunk's keys, so that answers carry no keys, and the chunk then
scores its documents with array look-ups.  A frequent word is one key per
chunk, so it makes no range larger than others.  Texts are shuffled once, to
meet their answers.  What the driver sees are counts by (context bucket, two
quantised probabilities), whose number is bounded whatever the input.

Words are told apart by 64-bit hashes: in a vocabulary of ten million two
words share one with a probability of about 3 in a million.  Pairs are told
apart likewise: of ten thousand million, about three share a hash.

Defined results: a null text counts as empty (its end token is scored); a null
id counts as id '' for the folds; ids may be of any type; repeated rows are
counted and scored each; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, utf8

END = b"\n"
END_HASH = xxhash.xxh64_intdigest(END)
BUCKETS = 24
STEPS = 4
NEVER = -(1 << 20)


def planes(x: np.ndarray) -> bytes:
    """Little-endian bytes of an array, grouped by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unplaned(data: bytes, kind: str) -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Known(dict):
    """word: its number in order of first sight; ``hashes`` by number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def pair_hash(before: np.ndarray, flat: np.ndarray) -> np.ndarray:
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (flat + (before >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


@dataclass
class Chunk:
    """Distinct keys of a chunk's documents, and where each token's are."""

    lengths: np.ndarray
    tokens: np.ndarray
    token_at: np.ndarray
    context_at: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Chunk:
        known = _Known()
        end = known[END]
        lengths = np.empty(len(texts), np.int64)
        each = []
        for k, text in enumerate(texts):
            words = text.lower().split()
            words.append(END)
            lengths[k] = len(words)
            each.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        number = np.concatenate(each) if each else np.empty(0, np.int32)
        hashed = np.array(known.hashes, np.uint64)
        order = np.argsort(hashed)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        context = np.empty_like(number)
        context[1:] = number[:-1]
        context[np.cumsum(lengths) - lengths] = end
        pairs, pair_at = np.unique(pair_hash(hashed[context], hashed[number]), return_inverse=True)
        return cls(lengths, hashed[order], place[number], place[context], pairs, pair_at.astype(np.int32))


@dataclass(frozen=True)
class Mixture:
    """Totals and weights (bucket, pair / token / uniform)."""

    n: int
    v: int
    weights: np.ndarray = field(default_factory=lambda: np.tile([0.6, 0.3, 0.1], (BUCKETS, 1)))

    def log10(self, pair: np.ndarray, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 probability of each token from its counts."""
        w = self.weights[bucket(context)]
        p = w[:, 2] / (self.v + 1)
        p = p + w[:, 1] * (token / max(self.n, 1))
        p = p + w[:, 0] * (pair / np.maximum(context, 1))
        return np.log10(p)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 more than the whole part of its count's binary logarithm."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def expectation_maximisation(cells: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Weights from rows (bucket, quantised pair and token probability, times)."""
    out = np.tile([0.6, 0.3, 0.1], (BUCKETS, 1))
    out[0] = [0.0, 0.75, 0.25]
    for b in range(BUCKETS):
        rows = cells[cells[:, 0] == b]
        if not len(rows):
            continue
        p = np.stack([np.where(rows[:, k] == NEVER, 0.0, np.exp2(np.maximum(rows[:, k], -4000) / STEPS)) for k in (1, 2)] + [np.full(len(rows), 1 / (v + 1))], axis=1)
        w = out[b].copy()
        for _ in range(rounds):
            share = p * w
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            w = (share * rows[:, 3:4]).sum(axis=0) + 1e-3
            w /= w.sum()
        out[b] = w
    return out


_ASKED = T.StructType([T.StructField("range", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("first", T.BinaryType()), T.StructField("fold", T.BinaryType())])
_TOLD = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("range", T.LongType()), T.StructField("main", T.BinaryType()), T.StructField("fold", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("v", T.LongType()), T.StructField("v_main", T.LongType()), T.StructField("n_main", T.LongType())])
_CELLS = T.StructType([T.StructField(n, T.LongType()) for n in ("b", "p2", "p1", "n")])
_SCORES = [T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


def _gathered(chunk_bytes: int):
    """Rows (of_fold, raw, ids, parts, sizes, texts) of about ``chunk_bytes`` each; a longer text is a row of its own."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        open_: dict[bool, list] = {True: [], False: []}
        sizes = {True: 0, False: 0}
        kind = None

        def row(fold: bool) -> pa.RecordBatch:
            ids, parts, texts = zip(*open_[fold])
            raw = sizes[fold]
            open_[fold], sizes[fold] = [], 0
            columns = [pa.array([int(fold)]), pa.array([raw]), pa.array([list(ids)], pa.list_(kind)), pa.array([bytes(parts)]), pa.array([planes(np.array(list(map(len, texts)), "<u8"))]), pa.array([press.compress(b"".join(texts))])]
            return pa.RecordBatch.from_arrays(columns, names=["of_fold", "raw", "ids", "parts", "sizes", "texts"])

        for batch in slices(batches):
            kind = batch.column(0).type
            for i, text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fold, raw = part == 1, utf8(text)
                if open_[fold] and sizes[fold] + len(raw) > chunk_bytes:
                    yield row(fold)
                open_[fold].append((i, part, raw))
                sizes[fold] += len(raw)
        for fold in (True, False):
            if open_[fold]:
                yield row(fold)

    return gather


def _texts(sizes: bytes, texts: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(texts)
    ends = np.cumsum(unplaned(sizes, "<u8")).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _ranges(keys: np.ndarray, power: int) -> list[int]:
    """Where each of 2 ** power equal key ranges starts in sorted keys, and the end."""
    edges = [np.uint64(k << (64 - power)) for k in range(1, 1 << power)]
    return [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]


def _ask(power: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name, parts, sizes, texts = (batch.column(k)[r].as_py() for k in range(4))
                chunk = Chunk.of(_texts(sizes, texts))
                role = np.repeat(np.frombuffer(parts, np.uint8), chunk.lengths)
                rows = []
                for order, (keys, at) in enumerate(((chunk.tokens, chunk.token_at), (chunk.pairs, chunk.pair_at))):
                    counts = [np.bincount(at[role == k], minlength=len(keys)).astype("<u4") for k in (0, 1)]
                    cuts = _ranges(keys, power)
                    for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if b > a:
                            steps = np.diff(keys[a:b] - np.uint64(r << (64 - power)), prepend=np.uint64(0))
                            rows.append((r + (order << power), name, planes(steps), planes(counts[0][a:b]), planes(counts[1][a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=_ASKED.names)

    return ask


def _tell(power: int):
    def tell(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unplaned(x, "<u8"), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        sizes = np.cumsum([0, *map(len, keys)])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        at = at.astype(np.int32)
        del keys
        totals = [np.zeros(len(distinct), np.uint64) for _ in range(2)]
        for total, name in zip(totals, ("first", "fold")):
            for k, x in enumerate(table.column(name).to_pylist()):
                total[at[sizes[k] : sizes[k + 1]]] += unplaned(x, "<u4")
        both = totals[0] + totals[1]
        tokens = table.column("range")[0].as_py() < 1 << power
        figures = (int(both.sum()), int((both > 0).sum()), int((totals[0] > 0).sum()), int(totals[0].sum())) if tokens else (0, 0, 0, 0)
        rows = []
        for k, (c, r) in enumerate(zip(table.column("chunk").to_pylist(), table.column("range").to_pylist())):
            own = at[sizes[k] : sizes[k + 1]]
            rows.append((c, r, planes(totals[0][own]), planes(totals[1][own]), *(figures if k == 0 else (0, 0, 0, 0))))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_TOLD.names)

    return tell


def _counts(chunk: Chunk, told: pa.Table, power: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the chunk's distinct tokens and pairs; with or without the fold's."""
    rows = sorted(zip(told.column("range").to_pylist(), told.column("main").to_pylist(), told.column("fold").to_pylist()))
    out = []
    for order, keys in enumerate((chunk.tokens, chunk.pairs)):
        own = [r for r in rows if r[0] >> power == order]
        n = np.concatenate([unplaned(r[1], "<u8") for r in own] or [np.empty(0, np.uint64)]).astype(np.int64)
        if fold:
            n += np.concatenate([unplaned(r[2], "<u8") for r in own] or [np.empty(0, np.uint64)]).astype(np.int64)
        if len(n) != len(keys):
            raise ValueError("a chunk's counts don't fit its keys")
        out.append(n)
    return out[0], out[1]


def _chunk_of(docs: pa.Table) -> Chunk:
    return Chunk.of(_texts(docs.column("sizes")[0].as_py(), docs.column("texts")[0].as_py()))


def _gather(power: int, n: int):
    def gather(docs: pa.Table, told: pa.Table) -> pa.Table:
        cells = np.empty((0, 4), np.int64)
        if len(docs):
            chunk = _chunk_of(docs)
            tokens, pairs = _counts(chunk, told, power, False)
            context = tokens[chunk.context_at]
            with np.errstate(divide="ignore"):
                p2 = np.log2(pairs[chunk.pair_at] / np.maximum(context, 1))
                p1 = np.log2(tokens[chunk.token_at] / max(n, 1))
            q2, q1 = (np.where(np.isfinite(p), np.rint(STEPS * p), NEVER).astype(np.int64) for p in (p2, p1))
            code = (bucket(context).astype(np.int64) << 42) + ((q2 - NEVER) << 21) + (q1 - NEVER)
            kinds, times = np.unique(code, return_counts=True)
            cells = np.stack([kinds >> 42, (kinds >> 21 & (1 << 21) - 1) + NEVER, (kinds & (1 << 21) - 1) + NEVER, times], axis=1)
        return pa.table([pa.array(cells[:, k]) for k in range(4)], names=_CELLS.names)

    return gather


def _score(power: int, model: Mixture):
    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        names = ["id", *(f.name for f in _SCORES)]
        kind = docs.schema.field("ids").type.value_type
        if not len(docs):
            return pa.table([pa.array([], t) for t in (kind, pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64())], names=names)
        chunk = _chunk_of(docs)
        tokens, pairs = _counts(chunk, told, power, True)
        c = tokens[chunk.token_at]
        starts = np.cumsum(chunk.lengths) - chunk.lengths
        base = np.add.reduceat(np.log10((c + 1) / (model.n + model.v + 1)), starts)
        own = np.add.reduceat(model.log10(pairs[chunk.pair_at], c, tokens[chunk.context_at]), starts)
        known = np.add.reduceat((c > 0).astype(np.int64), starts)
        held = np.frombuffer(docs.column("parts")[0].as_py(), np.uint8) == 2
        ids = docs.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(held), pa.array(chunk.lengths), pa.array(known), pa.array(np.full(len(ids), model.n)), pa.array(base), pa.array(own)], names=names)

    return score


def score(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, fold: int = 3, chunk_bytes: int = 8 << 20, range_bytes: int = 16 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32 of the id modulo ``folds`` is ``held_out`` are not learnt
    from; those where it is ``fold`` teach the mixture weights.  A task holds
    one chunk or one key range, which is what ``range_bytes`` of text send; the
    blocks exchanged are chunks times ranges, so larger executors should take
    larger ones.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rest = F.pmod(F.crc32(name), F.lit(folds))
    part = F.when(rest == held_out, 2).when(rest == fold, 1).otherwise(0)
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), part.cast("int").alias("part"))
    kind = df.schema[key].dataType
    gathered = T.StructType([T.StructField("of_fold", T.LongType()), T.StructField("raw", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(n, T.BinaryType()) for n in ("parts", "sizes", "texts"))])
    # A chunk's number is even or, of the fold, odd.
    chunks = cut(docs.mapInArrow(_gathered(chunk_bytes), gathered).withColumn("chunk", 2 * F.monotonically_increasing_id() + F.col("of_fold")), "chunks")
    size = chunks.agg(F.sum("raw").alias("n")).first().n or 0
    power = max(0, -(-size // range_bytes) - 1).bit_length()
    asked = chunks.select("chunk", "parts", "sizes", "texts").mapInArrow(_ask(power), _ASKED)
    told = cut(asked.groupBy("range").applyInArrow(_tell(power), _TOLD), "told")
    sums = told.agg(*[F.sum(c).alias(c) for c in ("n", "v", "v_main", "n_main")]).first()
    answers = told.select("chunk", "range", "main", "fold")
    of_fold = chunks.filter("of_fold = 1").select("chunk", "sizes", "texts").groupBy("chunk")
    cells = of_fold.cogroup(answers.filter(F.col("chunk") % 2 == 1).groupBy("chunk")).applyInArrow(_gather(power, sums.n_main or 0), _CELLS)
    found = cells.groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")).collect()
    weights = expectation_maximisation(np.array([tuple(r) for r in found], np.int64).reshape(-1, 4), sums.v_main or 0)
    model = Mixture(sums.n or 0, sums.v or 0, weights)
    own = chunks.select("chunk", "ids", "parts", "sizes", "texts").groupBy("chunk")
    return own.cogroup(answers.groupBy("chunk")).applyInArrow(_score(power, model), T.StructType([T.StructField("id", kind), *_SCORES]))
