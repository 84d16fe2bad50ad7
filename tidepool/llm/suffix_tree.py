"""LM scoring with a probabilistic suffix tree over words.

Contexts of up to ``depth`` words are kept where they are frequent enough and
their next-word distribution diverges from that of the context one word
shorter.  A word is predicted by the longest kept suffix of its history; a
word that this state does not list falls through, with the state's left-over
mass, to the next shorter state and in the end to the smoothed word
frequencies.  The probabilities of all words after any history add up to one.

How the work is split: counts of words, contexts and next words of the whole
training part are tables that grow with the corpus, and the divergence of each
context is found by joins.  What a kept context and a listed next word add to
the score of the shorter context is one number each, so that scoring sums what
the keys of a document's tokens add.  Keys above a share of all tokens are few
by definition (at most one in ``share`` of them can be); these are broadcast
and take part in the map that scores documents.  The other keys are asked for
in packed runs, one for each range of keys and some documents, which meet that
range of the tables in one task; back come sums, a row per run and document.
Bit filters of fixed size hold back keys that are in no table for certain; they
change no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import _text
from tidepool.plans.lineage import cut, release

U = np.uint64
_MULTIPLIER = U(0xD6E8FEB86659FD93)
#: The end of a text is a token like another; so is what stands before its first word.
END = _text.mix(np.array([0x656E64], U))[0]
START = _text.mix(np.array([0x7374617274], U))[0]
#: Tells the key of a context from that of the words it is made of; as neighbours they cost a run little more than one of them.
_CONTEXT = U(1)
#: Gains are kept in steps of 2**-36, so that their sums need fewer bytes and do not depend on an order.
_STEP = 2.0**-36


@dataclass(frozen=True)
class Tree:
    """Shares of all training tokens bound what is broadcast, not what is learnt.

    ``word_share``: words that are broadcast with their counts, at most 1 / word_share.
    ``context_share``, ``next_share``: contexts, and pairs of context and next word,
    that are broadcast, at most 1 / share of each length.  ``word_floor``: the least
    count of a broadcast word.  ``context_floor``, ``next_floor``: the least count of
    a context and of a listed next word, at every size.  ``divergence``: the least
    divergence (in nats, times the context's count) at which a context is kept.
    ``discount`` is taken off each listed count in favour of the shorter context,
    ``alpha`` is added to each word's count at the root.  ``filter_bits``: log2 of
    the most bits in a filter, which has 16 for each key up to that.  A range of keys that is summed at once holds ``range_tokens``
    grams at most on average; ``most_tasks`` bounds the tasks that sum them.
    """

    depth: int = 3
    word_share: float = 2.5e-7
    context_share: float = 2e-6
    next_share: float = 5e-7
    word_floor: int = 3
    context_floor: int = 6
    next_floor: int = 3
    divergence: float = 8.0
    discount: float = 0.75
    alpha: float = 0.1
    filter_bits: int = 27
    range_tokens: int = 2_000_000
    most_tasks: int = 10_000


def _tokens(column: pa.Array) -> _text.Words:
    """Word hashes of each row and one END."""
    words = _text.word_hashes(column)
    return _text.Words(np.insert(words.hashes, words.offsets[1:], END), words.offsets + np.arange(len(words.offsets)))


def _slices(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some MB of text, a row at least."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0)))])
    row = 0
    while row < batch.num_rows:
        end = min(max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1), row + (1 << 20))
        yield batch.slice(row, end - row)
        row = end


def _order(keys: np.ndarray) -> np.ndarray:
    """Places of the keys (hashes) in ascending order, those of equal keys in theirs."""
    bits = U(max(1, len(keys) - 1).bit_length())
    # One sort of plain numbers: the upper bits of a key, and its place.
    at = (np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=U)) & ((U(1) << bits) - U(1))).astype(np.int64)
    found = keys[at]
    down = np.flatnonzero(found[1:] < found[:-1])
    if len(down) > 1000:
        return np.argsort(keys, kind="stable")
    # Few keys share all their upper bits.
    upper = found >> bits
    for a, b in {(int(np.searchsorted(upper, u)), int(np.searchsorted(upper, u, "right"))) for u in upper[down]}:
        at[a:b] = at[a:b][np.argsort(found[a:b], kind="stable")]
    return at


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys starts."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _dealt(part: np.ndarray) -> np.ndarray:
    """Places in ascending order of small numbers, those of equal ones in theirs."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


class _Counter:
    """Sums counts by 64-bit key in sorted arrays, and hands them on when there are many.

    With ``more``, columns that follow from the key and tell it, these go out in its place.
    """

    def __init__(self, *more: str, most: int = 1_500_000) -> None:
        self.most, self.parts, self.size = most, [], 0
        self.names = ["n", *more] if more else ["h", "n"]

    def add(self, keys: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            order = _order(keys)
            keys = keys[order]
            first = _firsts(keys)
            self.parts.append((keys[first], np.diff(first, append=len(keys)), *(m[order[first]] for m in more)))
            self.size += len(first)
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.flush()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            keys, counts, *more = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = _order(keys)
            keys, counts = keys[order], counts[order]
            first = _firsts(keys)
            self.parts = [(keys[first], np.add.reduceat(counts, first), *(m[order[first]] for m in more))]
        self.size = sum(len(p[0]) for p in self.parts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for part in self.parts:
            part = part[-len(self.names) :]
            for at in range(0, len(part[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000].view(np.int64)) for c in part], names=self.names)
        self.parts, self.size = [], 0


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        for part in _slices(batch):
            yield from counter.add(_tokens(part.column("text")).hashes)
    yield from counter.flush()


def _shift(tokens: np.ndarray, offsets: np.ndarray, by: int) -> np.ndarray:
    """For every token the one ``by`` places before it in its row, START before the first."""
    out = np.full(len(tokens), START, U)
    if by < len(tokens):
        out[by:] = tokens[:-by]
    starts = offsets[:-1]
    for k in range(by):
        at = starts + k
        out[at[at < offsets[1:]]] = START
    return out


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 if it is not there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def context_key(previous: list[np.ndarray]) -> np.ndarray:
    """Key of a context, given its words from the newest to the oldest."""
    key = np.full(len(previous[0]), len(previous), U)
    for word in previous:
        key = _text.mix(key * _MULTIPLIER + word)
    return key


def next_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _text.mix((context ^ U(0x5DEECE66D)) * _MULTIPLIER + word)


def _grams(tokens: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each depth: places of tokens with so long a history (START counts once), and there the keys of context with token, of context, and of the shorter context with token."""
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    shorter = tokens
    for d in range(1, depth + 1):
        context = _shift(shorter, offsets, 1)
        key = _text.mix(context * _MULTIPLIER + shorter)
        at = np.flatnonzero(place >= d - 1)
        yield at, key[at], context[at], shorter[at]
        shorter = key


def _marks(keys: np.ndarray) -> np.ndarray:
    """Four bits of one word for each key."""
    mixed = _text.mix(keys * _MULTIPLIER)
    out = np.zeros(len(keys), U)
    for at in (0, 6, 12, 18):
        out |= U(1) << ((mixed >> U(at)) & U(63))
    return out


def _filter_batches(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Words of a filter (at, bits) with the marks of a column h."""
    own = np.zeros(1 << (bits - 6), U)
    for batch in batches:
        keys = batch.column("h").to_numpy().view(U)
        np.bitwise_or.at(own, (keys >> U(70 - bits)).astype(np.int64), _marks(keys))
    at = np.flatnonzero(own)
    for k in range(0, len(at), 1 << 18):
        part = at[k : k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(own[part].view(np.int64))], names=["at", "bits"])


def _filter(df: DataFrame, bits: int) -> np.ndarray:
    """A blocked Bloom filter of the keys h, of at most 2**bits bits: it holds back most keys that are not there and none that is."""
    bits = min(bits, max(12, (16 * df.count()).bit_length()))
    words = df.select("h").mapInArrow(lambda it: _filter_batches(it, bits), "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(U)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each key; False is certain."""
    marks = _marks(keys)
    return bits[(keys >> U(65 - len(bits).bit_length())).astype(np.int64)] & marks == marks


def _planes(values: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes before all second ones, so that a codec finds the empty ones."""
    values = values.view(f"u{values.itemsize}")
    return b"".join([(values >> values.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(values.itemsize)])


def _unplaned(data: memoryview, kind: np.dtype, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * kind.itemsize).reshape(kind.itemsize, n).T).view(kind).ravel()


def _squeezed(*parts: bytes) -> bytes:
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(run: bytes) -> bytes:
    return pa.decompress(run[8:], int.from_bytes(run[:8], "little"), codec="zstd", asbytes=True)


def _signed(values: np.ndarray) -> bytes:
    """Planes of whole numbers of either sign, small ones with empty upper bytes."""
    values = values.astype(np.int64)
    return _planes((values << 1) ^ (values >> 63))


def _unsigned(data: memoryview, n: int) -> np.ndarray:
    values = _unplaned(data, np.dtype(U), n)
    return (values >> U(1)).view(np.int64) ^ -(values & U(1)).view(np.int64)


_GRAMS = "range long, kind int, run binary"


def _gram_batches(batches: Iterable[pa.RecordBatch], seen, hot: np.ndarray, depth: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Contexts of this depth with their next words, where context and shorter may be in the level below.

    They are summed in the task and go out as packed runs, one for each range of keys: a row of its own
    would take three times the room in a shuffle.
    """
    counter = _Counter("context", "shorter")
    for batch in batches:
        for part in _slices(batch):
            *_, (_, key, context, shorter) = _grams(*_tokens(part.column("text")), depth)
            contexts, listed = seen.value
            may = np.flatnonzero(_maybe(contexts, context))
            may = may[_maybe(listed, shorter[may])]
            for found in counter.add(key[may], context[may], shorter[may]):
                yield from _packed(found, hot, ranges)
    for found in counter.flush():
        yield from _packed(found, hot, ranges)


def _packed(found: pa.RecordBatch, hot: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, kind, run): contexts in order with the number of their next words, then next words and counts."""
    n, context, shorter = (found.column(c).to_numpy() for c in ("n", "context", "shorter"))
    context, shorter = context.view(U), shorter.view(U)
    # A context's next words go to one range, those of a hot one to all.
    order = _order(context)
    n, context, shorter = n[order].astype(np.uint32), context[order], shorter[order]
    own = _firsts(context)
    spread = np.repeat(_lookup(hot, context[own]) >= 0, np.diff(own, append=len(context)))
    part = _text.mix(np.where(spread, context * _MULTIPLIER + shorter, context)) % U(ranges)
    order = _dealt(part)
    n, context, shorter, part = n[order], context[order], shorter[order], part[order]
    edges = [*_firsts(part).tolist(), len(part)]
    runs = []
    for a, b in zip(edges, edges[1:]):
        first = _firsts(context[a:b])
        many = np.diff(first, append=b - a).astype(np.uint32)
        steps = np.diff(context[a:b][first], prepend=U(0))
        runs.append(_squeezed(np.array([b - a, len(first)], np.int64).tobytes(), _planes(steps), shorter[a:b].tobytes(), _planes(many), _planes(n[a:b])))
    yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int64)), pa.array([_RUN] * len(runs), pa.int32()), pa.array(runs, pa.binary())], names=["range", "kind", "run"])


def _unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, shorter and count of each gram."""
    data = memoryview(_whole(run))
    size, contexts = np.frombuffer(data, np.int64, 2).tolist()
    own = np.cumsum(_unplaned(data[16:], np.dtype(U), contexts), dtype=U)
    at = 16 + 8 * contexts
    shorter = np.frombuffer(data, U, size, at)
    many = _unplaned(data[at + 8 * size :], np.dtype(np.uint32), contexts)
    n = _unplaned(data[at + 8 * size + 4 * contexts :], np.dtype(np.uint32), size)
    return np.repeat(own, many), shorter, n.astype(np.int64)


def _total_batches(batches: Iterable[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Packed runs of contexts (h) with their counts (n), each in the range of its next words."""
    for batch in batches:
        if batch.num_rows:
            h = batch.column("h").to_numpy().view(U)
            order = _order(h)
            h, n = h[order], batch.column("n").to_numpy()[order]
            part = _text.mix(h) % U(ranges)
            order = _dealt(part)
            h, n, part = h[order], n[order], part[order]
            edges = [*_firsts(part).tolist(), len(part)]
            runs = [_squeezed(np.array([b - a], np.int64).tobytes(), _planes(np.diff(h[a:b], prepend=U(0))), _planes(n[a:b])) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int64)), pa.array([_TABLE] * len(runs), pa.int32()), pa.array(runs, pa.binary())], names=["range", "kind", "run"])


def _totals(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = memoryview(_whole(run))
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.cumsum(_unplaned(data[8:], np.dtype(U), n), dtype=U), _unplaned(data[8 + 8 * n :], np.dtype(np.int64), n)


def _listed_batches(batches: Iterable[pa.RecordBatch], hot: tuple[np.ndarray, np.ndarray], floor: int) -> Iterator[pa.RecordBatch]:
    """Runs by range: (n, context, total, shorter) of the grams counted ``floor`` times or more, with their contexts' counts."""
    now, held, tables = None, [], []

    def summed() -> Iterator[pa.RecordBatch]:
        context, shorter, n = (np.concatenate(c) for c in zip(*held, strict=True))
        key = _text.mix(context * _MULTIPLIER + shorter)
        order = _order(key)
        first = _firsts(key[order])
        total, own = np.add.reduceat(n[order], first), order[first]
        keep = total >= floor
        own, total = own[keep], total[keep]
        known, counts = (np.concatenate(c) for c in zip(hot, *tables, strict=True))
        order = _order(known)
        at = _lookup(known[order], context[own])
        # The filter also lets through a few contexts that are not frequent enough.
        own, total, counts = own[at >= 0], total[at >= 0], counts[order[at[at >= 0]]]
        for k in range(0, len(own), 100_000):
            part = own[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(total[k : k + 100_000]), pa.array(context[part].view(np.int64)), pa.array(counts[k : k + 100_000]), pa.array(shorter[part].view(np.int64))], names=["n", "context", "total", "shorter"])

    for batch in batches:
        for part, kind, run in zip(batch.column("range").to_pylist(), batch.column("kind").to_pylist(), batch.column("run"), strict=True):
            if part != now:
                if held:
                    yield from summed()
                now, held, tables = part, [], []
            (tables if kind == _TABLE else held).append((_totals if kind == _TABLE else _unpacked)(run.as_py()))
    if held:
        yield from summed()


def _keyed_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key h of context and shorter, in the place of shorter."""
    for batch in batches:
        context, shorter = (batch.column(c).to_numpy().view(U) for c in ("context", "shorter"))
        key = _text.mix(context * _MULTIPLIER + shorter)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c) for c in ("n", "context", "total", "q"))], names=["h", "n", "context", "total", "q"])


@dataclass(frozen=True)
class _Model:
    """What scoring needs, all of bounded size: what frequent keys add, a filter of all keys that add something, and the counts of frequent words."""

    keys: np.ndarray
    values: np.ndarray
    seen: np.ndarray
    words: np.ndarray
    log_base: np.ndarray


_TABLE, _RUN, _ROW = 0, 1, 2
_SCORED = "range long, kind int, run binary, row long, doc long, n_tokens long, n_known long, base double, score double"
_TOLD = "first long, run binary, row long, doc long, n_tokens long, n_known long, base double, score double"
_SUMS = "row long, doc long, n_tokens long, n_known long, base double, score double"


def _partial(schema: str, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of this schema; columns that are not given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _places(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key; a context goes with the words it is made of."""
    return (h >> U(1)) % U(ranges)


def _within(h: np.ndarray, ranges: int) -> bytes:
    """Ascending keys of one range, as steps between what the range does not tell."""
    return _planes(np.diff((h >> U(1)) // U(ranges) << U(1) | h & U(1), prepend=U(0)))


def _keys(data: memoryview, n: int, part: int, ranges: int) -> np.ndarray:
    own = np.cumsum(_unplaned(data, np.dtype(U), n), dtype=U)
    return ((own >> U(1)) * U(ranges) + U(part)) << U(1) | own & U(1)


def _asked(parts: list[tuple[np.ndarray, np.ndarray]], first_row: int, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Runs of what a few documents ask for, by range: keys of words, then of the tree, in order, with document and number of times."""
    made: dict[int, list[bytes]] = {}
    for kind, (h, owner) in enumerate(parts):
        order = _order(h)
        h, owner = h[order], owner[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
        times = np.diff(new, append=len(h)).astype(np.uint32)
        h, owner = h[new], owner[new].astype(np.uint32)
        part = _places(h, ranges)
        order = _dealt(part)
        h, owner, times, part = h[order], owner[order], times[order], part[order]
        edges = _firsts(part).tolist()
        for a, b in zip(edges, [*edges[1:], len(h)]):
            made.setdefault(int(part[a]), [b"", b""])[kind] = np.array([b - a], np.int64).tobytes() + _within(h[a:b], ranges) + _planes(owner[a:b]) + _planes(times[a:b])
    for number, runs in made.items():
        yield number, _squeezed(np.array([first_row], np.int64).tobytes(), *(r or np.zeros(1, np.int64).tobytes() for r in runs))


def _questions(run: bytes, part: int, ranges: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    data, out, at = memoryview(_whole(run)), [], 8
    for _ in range(2):
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        owner, times = (_unplaned(data[at + 8 + k * n :], np.dtype(np.uint32), n) for k in (8, 12))
        out.append((_keys(data[at + 8 :], n, part, ranges), owner.astype(np.int64), times))
        at += 8 + 16 * n
    return int(np.frombuffer(data, np.int64, 1)[0]), out


def _score_batches(batches: Iterable[pa.RecordBatch], model, how: Tree, ranges: int) -> Iterator[pa.RecordBatch]:
    """A row per document with what the broadcast keys tell, and runs of the keys (of words, or of the tree) that are not broadcast."""
    context = TaskContext.get()
    # Each slice of documents has a stretch of 2**20 numbers to itself.
    row_id = (context.partitionId() if context else 0) << 40
    m: _Model = model.value
    for batch in batches:
        for part in _slices(batch):
            tokens, offsets = _tokens(part.column("text"))
            rows = part.num_rows
            owner = np.repeat(np.arange(rows), np.diff(offsets))
            # Each key is looked for once, and in order.
            order = _order(tokens)
            h, own = tokens[order], owner[order]
            first = _firsts(h)
            many = np.diff(first, append=len(h))
            word = _lookup(m.words, h[first])
            common = np.repeat(word >= 0, many)
            base = np.bincount(own, weights=np.repeat(np.where(word >= 0, m.log_base[np.maximum(word, 0)] if len(m.words) else 0.0, 0.0), many), minlength=rows)
            known = np.bincount(own, weights=common, minlength=rows).astype(np.int64)
            rare, asked, steps = (h[~common], own[~common]), [], np.zeros(rows)

            def ask(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
                """Add what the keys of tokens ``at`` tell, or ask for it; returns which keys may be in the tree."""
                order = _order(keys)
                h, own = keys[order], owner[at[order]]
                first = _firsts(h)
                many = np.diff(first, append=len(h))
                may = _maybe(m.seen, h[first])
                found = np.full(len(first), -1)
                found[may] = _lookup(m.keys, h[first][may])
                hit = found >= 0
                told = np.repeat(hit, many)
                steps[:] += np.bincount(own[told], weights=np.repeat(m.values[found[hit]], many[hit]), minlength=rows)
                left = np.repeat(may & ~hit, many)
                asked.append((h[left], own[left]))
                out = np.zeros(len(keys), bool)
                out[order] = np.repeat(may, many)
                return out

            for at, key, before, _ in _grams(tokens, offsets, how.depth):
                # A next word adds something only behind a kept context.
                kept = ask(before ^ _CONTEXT, at)
                ask(key[kept], at[kept])
            sums = [base, base + _STEP * steps]
            ids = row_id + np.arange(rows)
            yield _partial(_SCORED, range=np.mod(ids, ranges), kind=np.full(rows, _ROW), row=ids, doc=part.column("doc"), n_tokens=np.diff(offsets), n_known=known, base=sums[0], score=sums[1])
            runs = list(_asked([rare, tuple(np.concatenate(x) for x in zip(*asked, strict=True))], row_id, ranges))
            if runs:
                yield _partial(_SCORED, range=[r[0] for r in runs], kind=[_RUN] * len(runs), run=[r[1] for r in runs])
            row_id += 1 << 20


def _table_batches(batches: Iterable[pa.RecordBatch], ranges: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Packed runs of (h, n, gain) by range: words with their counts, then keys of the tree with what they add."""
    held: list[tuple] = []

    def packed() -> Iterator[pa.RecordBatch]:
        h, n, gain = (np.concatenate(c) for c in zip(*held, strict=True))
        order = _order(h.view(U))
        h, n, gain = h[order].view(U), n[order], gain[order]
        part, in_tree = _places(h, ranges), np.isnan(n)
        order = _dealt(part * U(2) + in_tree)
        h, part, in_tree, n, gain = h[order], part[order].astype(np.int64), in_tree[order], n[order], gain[order]
        edges = [*_firsts(part).tolist(), len(part)]
        runs = []
        for a, b in zip(edges, edges[1:]):
            cut_at = a + int(np.count_nonzero(~in_tree[a:b]))
            words = np.array([cut_at - a, b - cut_at], np.int64).tobytes() + _within(h[a:cut_at], ranges) + _planes(n[a:cut_at].astype(np.int64))
            runs.append(_squeezed(words, _within(h[cut_at:b], ranges), _signed(np.rint(gain[cut_at:b] / _STEP))))
        yield _partial(_SCORED, range=part[edges[:-1]], kind=np.full(len(runs), _TABLE), run=runs)
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "n", "gain")))
            held[-1] = (held[-1][0], held[-1][1].astype(float), held[-1][2].astype(float))
            if sum(len(x[0]) for x in held) > most:
                yield from packed()
    if held:
        yield from packed()


def _table_parts(run: bytes, part: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(_whole(run))
    words, keys = np.frombuffer(data, np.int64, 2).tolist()
    n = _unplaned(data[16 + 8 * words :], np.dtype(np.int64), words)
    at = 16 + 16 * words
    return _keys(data[16:], words, part, ranges), n, _keys(data[at:], keys, part, ranges), _unsigned(data[at + 8 * keys :], keys)


def _answer_batches(batches: Iterable[pa.RecordBatch], ranges: int, alpha: float, log_norm: float) -> Iterator[pa.RecordBatch]:
    """Rows by range, tables before runs: for every run, in one row, the sums that its documents asked for; documents' own rows go through."""
    now, held, table = None, [], None

    def sorted_table() -> list[tuple[np.ndarray, np.ndarray]]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, U), np.zeros(0), np.zeros(0, U), np.zeros(0)]
        orders = [_order(columns[k]) for k in (0, 2)]
        return [(columns[k][o], columns[k + 1][o]) for k, o in zip((0, 2), orders, strict=True)]

    def found(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, values[np.maximum(at, 0)] if len(values) else 0, 0)

    for batch in batches:
        parts, kinds = batch.column("range").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.concatenate([np.ones(min(1, len(parts)), bool), (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])])).tolist()
        for a, b in zip(edges, [*edges[1:], len(parts)]):
            part = batch.slice(a, b - a)
            if parts[a] != now:
                now, held, table = parts[a], [], None
            if kinds[a] == _TABLE:
                held += [_table_parts(run.as_py(), int(now), ranges) for run in part.column("run")]
            elif kinds[a] == _ROW:
                yield _partial(_TOLD, **{c: part.column(c) for c in ("row", "doc", "n_tokens", "n_known", "base", "score")}, first=pa.array(part.column("row").to_numpy() >> 20))
            else:
                table = table or sorted_table()
                for run in part.column("run"):
                    first, (of_words, of_tree) = _questions(run.as_py(), int(now), ranges)
                    h, owner, times = of_words
                    n = found(_lookup(table[0][0], h), table[0][1])
                    own = times * (np.log10(n + alpha) - log_norm)
                    h, to, many = of_tree
                    gain = many * found(_lookup(table[1][0], h), table[1][1])
                    size = int(max(owner.max(initial=-1), to.max(initial=-1))) + 1
                    known, base, more = (np.bincount(o, weights=w, minlength=size) for o, w in ((owner, times * (n > 0)), (owner, own), (to, gain)))
                    rows = np.flatnonzero((np.bincount(owner, minlength=size) > 0) | (more != 0))
                    # Few words are asked for by a document in one range, so their sums are much the same.
                    bases, at = np.unique(base[rows], return_inverse=True)
                    sums = _squeezed(np.array([first, len(rows), len(bases)], np.int64).tobytes(), bases.tobytes(), _planes(np.diff(rows, prepend=0).astype(np.uint32)), _planes(known[rows].astype(np.uint32)), _planes(at.astype(np.uint32)), _signed(np.rint(more[rows])))
                    yield _partial(_TOLD, first=[first >> 20], run=pa.array([sums], pa.binary()))


def _sum_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by ``first``: each stretch of documents with all its sums added up."""
    now, own, sums = None, [], []

    def added() -> pa.RecordBatch:
        told = pa.Table.from_batches(own).sort_by("row")
        rows = told.column("row").to_numpy()
        totals = [told.column(c).to_numpy().astype(float) for c in ("n_known", "base", "score")]
        for run in sums:
            data = memoryview(_whole(run))
            first, n, distinct = np.frombuffer(data, np.int64, 3).tolist()
            bases, data = np.frombuffer(data, float, distinct, 24), data[24 + 8 * distinct :]
            steps, known, index = (_unplaned(data[4 * k * n :], np.dtype(np.uint32), n) for k in range(3))
            at, base = np.searchsorted(rows, first + np.cumsum(steps, dtype=np.int64)), bases[index]
            for total, part in zip(totals, (known, base, base + _STEP * _unsigned(data[12 * n :], n)), strict=True):
                total[at] += part
        return pa.RecordBatch.from_arrays([told.column("row").combine_chunks(), told.column("doc").combine_chunks(), told.column("n_tokens").combine_chunks(), pa.array(totals[0].astype(np.int64)), *(pa.array(t) for t in totals[1:])], names=[f.split()[0] for f in _SUMS.split(", ")])

    for batch in batches:
        firsts, is_run = batch.column("first").to_numpy(), np.asarray(batch.column("run").is_valid())
        edges = np.flatnonzero(np.concatenate([np.ones(min(1, len(firsts)), bool), firsts[1:] != firsts[:-1]])).tolist()
        for a, b in zip(edges, [*edges[1:], len(firsts)]):
            if firsts[a] != now:
                if own:
                    yield added()
                now, own, sums = firsts[a], [], []
            part = batch.slice(a, b - a)
            sums += [r.as_py() for r in part.column("run").filter(pa.array(is_run[a:b]))]
            if not is_run[a:b].all():
                own.append(part.filter(pa.array(~is_run[a:b])).select(["row", "doc", "n_tokens", "n_known", "base", "score"]))
    if own:
        yield added()


def _array(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a table of proven size, in the order of its first as unsigned."""
    table = df.select(*columns).toArrow()
    arrays = [table.column(c).to_numpy() for c in columns]
    arrays[0] = arrays[0].astype(np.int64).view(U)
    order = np.argsort(arrays[0], kind="stable")
    return [a[order] for a in arrays]


class _Growing:
    """The tree in memory, as it is defined: kept states with their left-over, and their listed next words."""

    def __init__(self) -> None:
        self.states, self.weights = np.zeros(0, U), np.zeros(0)
        self.nexts, self.values = np.zeros(0, U), np.zeros(0)

    def add(self, states: np.ndarray, weights: np.ndarray, nexts: np.ndarray, values: np.ndarray) -> None:
        self.states, self.weights = self._merged(self.states, self.weights, states, weights)
        self.nexts, self.values = self._merged(self.nexts, self.values, nexts, values)

    @staticmethod
    def _merged(keys, values, more, more_values):
        keys, values = np.concatenate([keys, more]), np.concatenate([values, more_values])
        order = np.argsort(keys)
        return keys[order], values[order]

    def log_probability(self, history: list[np.ndarray], word: np.ndarray, log_base: np.ndarray) -> np.ndarray:
        """log10 probability of each word after its history (newest first)."""
        out, settled = np.zeros(len(word)), np.zeros(len(word), bool)
        for depth in range(len(history), 0, -1):
            keys = context_key(history[:depth])
            state = _lookup(self.states, keys)
            listed = np.where(state >= 0, _lookup(self.nexts, next_key(keys, word)), -1)
            hit = (listed >= 0) & ~settled
            fall = (state >= 0) & ~settled & ~hit
            out[hit] += self.values[listed[hit]]
            settled |= hit
            out[fall] += self.weights[state[fall]]
        return out + np.where(settled, 0.0, log_base)

    def grow(self, history: np.ndarray, total: np.ndarray, owner: np.ndarray, word: np.ndarray, n: np.ndarray, log_base: np.ndarray, how: Tree) -> None:
        """Decide on contexts (rows of ``history``, newest first) with their listed next words (``owner``: the context's row)."""
        depth = history.shape[1]
        p = (n - how.discount) / total[owner]
        q = 10 ** self.log_probability([history[owner, k] for k in range(depth - 1)], word, log_base)
        rows = len(history)
        left = np.maximum(1 - np.bincount(owner, weights=p, minlength=rows), 1e-12)
        left_parent = np.maximum(1 - np.bincount(owner, weights=q, minlength=rows), 1e-12)
        unlisted = np.maximum(total - np.bincount(owner, weights=n, minlength=rows), 0)
        divergence = np.bincount(owner, weights=n * np.log(p / q), minlength=rows) + unlisted * np.log(left / left_parent)
        keep = divergence >= how.divergence
        keys = context_key([history[:, k] for k in range(depth)])
        chosen = keep[owner]
        self.add(keys[keep], np.log10(left / left_parent)[keep], next_key(keys[owner[chosen]], word[chosen]), np.log10(p[chosen]))


def _met(many: DataFrame, one: DataFrame, key: str, often: int) -> DataFrame:
    """Inner join of many rows to one per key; the few keys counted ``often`` (column ``times``) or more are broadcast, the others are dealt by key."""
    hot = F.broadcast(one.filter(F.col("times") >= often).drop("times"))
    rest = many.join(F.broadcast(one.filter(F.col("times") >= often).select(key)), key, "left_anti")
    return many.join(hot, key).unionByName(rest.join(one.filter(F.col("times") < often).drop("times"), key))


def _level(raw: DataFrame, below: DataFrame, how: Tree, often: int) -> tuple[DataFrame, DataFrame]:
    """The next level (h, n, q), and what it adds to the scores of the level below: (h, times, in_pair, gain).

    ``raw``: (n, context, total, shorter) of listed next words; ``below``: (h, n, q)
    of the level below, q the log10 probability of a key's last word after the others.
    """
    parents = below.select(F.col("h").alias("shorter"), "q", F.col("n").alias("times"))
    listed = cut(_met(raw, parents, "shorter", often).select("n", "context", "total", "shorter", "q").mapInArrow(_keyed_batches, "h long, n long, context long, total long, q double"))
    p, q = (F.col("n") - how.discount) / F.col("total"), F.pow(F.lit(10.0), "q")
    sums = {"lead": F.min("h"), "all_n": F.sum("n"), "all_p": F.sum(p), "all_q": F.sum(q), "own": F.sum(F.col("n") * F.log(p / q))}
    # Each context's next words meet once; of the frequent contexts, which are few, the sums go to the words.
    hot, one = listed.filter(F.col("total") >= often), Window.partitionBy("context")
    met = hot.join(F.broadcast(cut(hot.groupBy("context").agg(*(x.alias(name) for name, x in sums.items())))), "context")
    met = met.unionByName(listed.filter(F.col("total") < often).select("*", *(x.over(one).alias(name) for name, x in sums.items())))
    ratio = F.greatest(1 - F.col("all_p"), F.lit(1e-12)) / F.greatest(1 - F.col("all_q"), F.lit(1e-12))
    divergence = F.col("own") + F.greatest(F.col("total") - F.col("all_n"), F.lit(0)) * F.log(ratio)
    met = met.withColumn("weight", F.when(divergence >= how.divergence, F.log10(ratio)))
    leads = F.col("weight").isNotNull() & (F.col("h") == F.col("lead"))
    told = (F.when(leads, F.col(c)).alias(c) for c in ("context", "total", "weight"))
    judged = cut(met.select("h", "n", F.when(F.col("weight").isNull(), F.col("q")).otherwise(F.log10(p)).alias("q"), (F.log10(p) - F.col("q") - F.col("weight")).alias("gain"), *told))
    release(listed)
    tag = F.lit(int(_CONTEXT.astype(np.int64)))
    of_contexts = judged.filter("context IS NOT NULL").select(F.col("context").bitwiseXOR(tag).alias("h"), F.col("total").alias("times"), F.lit(False).alias("in_pair"), F.col("weight").alias("gain"))
    of_words = judged.filter("gain IS NOT NULL").select("h", F.col("n").alias("times"), F.lit(True).alias("in_pair"), "gain")
    return judged.select("h", "n", "q"), of_contexts.unionByName(of_words)


def score_texts(df: DataFrame, training: Column, text: str = "text", doc: str = "doc_id", *, how: Tree = Tree()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    ``training``: whether a row's text is learnt from.  Tokens are words,
    lower-cased in A-Z, and one end per text; ``n_known`` counts those seen in
    training.  ``base_score`` is the log10 probability by smoothed word
    frequencies alone, ``score`` that by the tree.  A null or empty text is the
    end alone; a null ``training`` counts as held out; repeated rows are learnt
    from and scored each; a null id stays null.  Without training text every
    token has the same probability.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    learnt = rows.filter("learn").select("text")
    counts = cut(learnt.mapInArrow(_count_batches, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    sizes = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = sizes["total"] or 0, sizes["distinct"]

    def floor(share: float, least: int) -> int:
        return max(least, int(np.ceil(share * total)))

    # At most 1 / word_share words can be this frequent.
    words, word_counts = _array(counts.filter(F.col("n") >= floor(how.word_share, how.word_floor)), "h", "n")
    log_norm = float(np.log10(total + how.alpha * (distinct + 1)))
    log_base = np.log10(word_counts + how.alpha) - log_norm

    # Level by level: a context is a listed word of the level below with its own context.  START stands before every text, as often as END behind it.
    context = spark.sparkContext
    end, start = (F.lit(int(x.astype(np.int64))) for x in (END, START))
    own = counts.filter(F.col("n") >= how.next_floor)
    level = own.select("h", "n", (F.log10(F.col("n") + how.alpha) - log_norm).alias("q")).unionByName(own.filter(F.col("h") == end).select(start.alias("h"), "n", F.lit(None).cast("double").alias("q")))
    gains, ranges = [], max(1, total // how.range_tokens)
    for depth in range(1, how.depth + 1):
        seen = context.broadcast((_filter(level.filter(F.col("n") >= how.context_floor), how.filter_bits), _filter(level, how.filter_bits)))
        # At most one in ``range_tokens`` tokens' contexts can be so frequent.
        hot = tuple(_array(level.filter(F.col("n") >= max(how.range_tokens, how.context_floor)), "h", "n"))
        runs = learnt.mapInArrow(lambda it, s=seen, d=depth, t=hot[0]: _gram_batches(it, s, t, d, ranges), _GRAMS)
        runs = runs.unionByName(level.filter((F.col("n") >= how.context_floor) & (F.col("n") < how.range_tokens)).select("h", "n").mapInArrow(lambda it: _total_batches(it, ranges), _GRAMS))
        # A range holds some 2M of the tokens' grams, and a task takes one after another.
        runs = runs.repartition(min(ranges, how.most_tasks), "range").sortWithinPartitions("range", "kind")
        raw = cut(runs.mapInArrow(lambda it, t=hot: _listed_batches(it, t, how.next_floor), "n long, context long, total long, shorter long"))
        seen.destroy()
        if raw.isEmpty():
            break
        level, added = _level(raw, level, how, floor(how.context_share, how.context_floor))
        release(raw)
        gains.append(added)
    adds = gains[0] if gains else spark.createDataFrame([], "h long, times long, in_pair boolean, gain double")
    for more in gains[1:]:
        adds = adds.unionByName(more)
    # Both are bounded by their shares of all tokens, as the words are.
    often = F.col("times") >= F.when(F.col("in_pair"), floor(how.next_share, how.next_floor)).otherwise(floor(how.context_share, how.context_floor))
    keys, values = _array(adds.filter(often), "h", "gain")
    model = context.broadcast(_Model(keys, np.rint(values / _STEP), _filter(adds, how.filter_bits), words, log_base))

    parts = rows.select("doc", "text").mapInArrow(lambda it: _score_batches(it, model, how, ranges), _SCORED)
    tables = counts.select("h", "n", F.lit(None).cast("double").alias("gain")).unionByName(adds.filter(~often).select("h", F.lit(None).cast("long").alias("n"), "gain"))
    tables = tables.mapInArrow(lambda it: _table_batches(it, ranges), _SCORED)
    met = parts.unionByName(tables).repartition(min(ranges, how.most_tasks), "range").sortWithinPartitions("range", "kind")
    told = met.mapInArrow(lambda it: _answer_batches(it, ranges, how.alpha, log_norm), _TOLD)
    summed = told.repartition("first").sortWithinPartitions("first").mapInArrow(_sum_batches, _SUMS)
    return summed.select(F.col("doc").alias("doc_id"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
