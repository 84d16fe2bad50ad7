"""Sequence packing by vector bin packing with the dot-product heuristic.

Training examples are placed into sequences ("bins") under simultaneous limits
on tokens, segments and loss-bearing tokens.  Each task fills one bin at a
time: of the waiting examples that fit, the one whose (capacity-scaled)
requirement vector has the largest dot product with the bin's remaining
capacity goes next, so large examples and examples that use what the bin has
most of are preferred.  When nothing fits whole, the example with the largest
product is cut to fill the bin, so no sequence but a task's last needs padding;
the last is cut at powers of two, which need none either.

The work is a single map over the input's partitions: no shuffle, and a
partition is read as a stream with a waiting pool of bounded size.  A lost task
repeats the same placement, because it depends on its partition's rows alone.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import _text
from tidepool.llm._sql import by_place

#: Sequence ids are partition * SPAN + position, so they never meet.
SPAN = 1 << 36
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass(frozen=True)
class Pool:
    """Bounds of the examples that wait in a task: it is refilled below ``low`` and up to ``high`` examples or ``tokens``."""

    low: int = 256
    high: int = 768
    tokens: int = 4_000_000


class _Packer:
    """Places one partition's examples; pieces are reported to ``emit`` in order of their sequence."""

    def __init__(self, limits: Limits, pool: Pool, first_id: int, emit: Callable) -> None:
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.pool, self.emit, self.next_id = pool, emit, first_id
        self.need = np.zeros((0, 3))  # tokens, segments, loss tokens still to place
        self.items: list = []  # (key, ids, loss prefix sums or None, next position)
        self.left, self.held = self.cap.copy(), []

    def waiting(self) -> int:
        return len(self.items)

    def add(self, examples: list[tuple]) -> None:
        """examples: (key, ids, loss prefix sums or None)."""
        rows = []
        for key, ids, loss in examples:
            at = 0
            # Whole sequences' worth go out at once; they fill a bin alone.
            while len(ids) - at > self.cap[0] and (end := self._reach(ids, loss, at, self.cap)) - at == self.cap[0]:
                self.emit(key, ids, loss, at, end, self.next_id, 0)
                self.next_id, at = self.next_id + 1, end
            self.items.append((key, ids, loss, at))
            rows.append((len(ids) - at, 1, self._loss(ids, loss, at, len(ids))))
        if rows:
            self.need = np.vstack([self.need, np.array(rows, float)])

    @staticmethod
    def _loss(ids: np.ndarray, loss: np.ndarray | None, start: int, end: int) -> int:
        return end - start if loss is None else int(loss[end] - loss[start])

    @staticmethod
    def _reach(ids: np.ndarray, loss: np.ndarray | None, at: int, room: np.ndarray) -> int:
        """How far a piece from ``at`` can go in the room given."""
        end = min(len(ids), at + int(room[0]))
        if loss is None:
            return min(end, at + int(room[2]))
        return min(end, int(np.searchsorted(loss, loss[at] + int(room[2]), "right")) - 1)

    def fill(self, least: int) -> None:
        """Fill bins until no more than ``least`` examples wait."""
        alive = np.ones(len(self.items), bool)
        need, n = self.need, len(self.items)
        while n > least:
            weight = self.left / self.cap**2
            score = need @ weight
            fits = (need <= self.left).all(axis=1) & alive
            # The last free segment should close the bin, not leave it half empty.
            closing = self.left[1] <= 1
            if closing:
                fits &= need[:, 0] >= self.left[0]
            if fits.any():
                k = int(np.where(fits, score, -1.0).argmax())
                self._place(k, len(self.items[k][1]))
                alive[k], n = False, n - 1
            else:
                order = np.where(alive, np.minimum(need[:, 0], self.left[0]) * 1e6 + score, -1.0)
                k = int(order.argmax())
                key, ids, loss, at = self.items[k]
                end = self._reach(ids, loss, at, self.left)
                if end > at:
                    self._place(k, end)
                    if end == len(ids):
                        alive[k], n = False, n - 1
                    else:
                        need[k] = (len(ids) - end, 1, self._loss(ids, loss, end, len(ids)))
                elif not self.held:
                    # Only an empty example gets here; it needs no room.
                    alive[k], n = False, n - 1
                else:
                    self._close()
            if self.left[0] < 1 or self.left[1] < 1 or (self.left[2] < 1 and not self._free_of_loss(need, alive)):
                self._close()
        keep = np.flatnonzero(alive)
        self.need, self.items = need[keep], [self.items[k] for k in keep]

    def _free_of_loss(self, need: np.ndarray, alive: np.ndarray) -> bool:
        return bool(((need[:, 2] < need[:, 0]) & alive).any())

    def _place(self, k: int, end: int) -> None:
        key, ids, loss, at = self.items[k]
        self.held.append((key, ids, loss, at, end))
        self.left -= (end - at, 1, self._loss(ids, loss, at, end))
        self.items[k] = (key, ids, loss, end)

    def finish(self) -> None:
        """Place all that waits."""
        self.fill(0)
        self._close()

    def _close(self) -> None:
        """Emit the bin as a sequence; one that is not full, as another limit or the end of all was reached, as sequences of powers of two."""
        pieces, at, room = [p for p in self.held[::-1] if p[4] > p[3]], 0, 0
        total = sum(end - start for *_, start, end in pieces)
        self.left, self.held = self.cap.copy(), []
        if total == self.cap[0]:
            room, total = total, 0
        while pieces:
            if not room:
                room, at = 1 << (total.bit_length() - 1), 0
                total -= room
            key, ids, loss, start, end = pieces.pop()
            cut = min(end, start + room)
            self.emit(key, ids, loss, start, cut, self.next_id, at)
            at, room = at + cut - start, room - (cut - start)
            if cut < end:
                pieces.append((key, ids, loss, cut, end))
            if not room:
                self.next_id += 1


def _pack(batches: Iterable[pa.RecordBatch], read: Callable, limits: Limits, pool: Pool, columns: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """read: gives (ids, loss prefix sums or None) of each row of a batch, one by one."""
    context = TaskContext.get()
    out: list[list] = [[] for _ in range(8)]

    def emit(key, ids, loss, start, end, sequence, offset):
        part = ids[start:end]
        for column, value in zip(out, (key, start, end - start, zlib.crc32(part.tobytes()), len(ids), sequence, offset, _Packer._loss(ids, loss, start, end)), strict=True):
            column.append(value)
        if with_ids:
            id_parts.append(part)

    id_parts: list[np.ndarray] = []
    def flush():
        tables, rows = [], out[0]
        # Rows of one batch are taken together; their order within the result carries no meaning.
        by: dict[int, list[int]] = {}
        for n, (b, _) in enumerate(rows):
            by.setdefault(id(b), []).append(n)
        for group in by.values():
            batch = rows[group[0]][0]
            own = batch.take(pa.array([rows[n][1] for n in group], pa.int64())).select(columns)
            arrays = [*own.columns, *(pa.array([column[n] for n in group], pa.int64()) for column in out[1:])]
            names = [*columns, *(x.split()[0] for x in PIECES.split(", "))]
            if with_ids:
                arrays.append(pa.array([id_parts[n].astype(np.int32) for n in group], pa.list_(pa.int32())))
                names.append("ids")
            tables.append(pa.RecordBatch.from_arrays(arrays, names=names))
        for column in out:
            column.clear()
        id_parts.clear()
        return tables

    packer = _Packer(limits, pool, (context.partitionId() if context else 0) * SPAN, emit)
    tokens, fresh = 0, []
    for batch in batches:
        slim = batch.select(columns)
        for row, (ids, loss) in enumerate(read(batch)):
            fresh.append(((slim, row), ids, loss))
            tokens += len(ids)
            if len(fresh) + packer.waiting() >= pool.high or tokens >= pool.tokens:
                packer.add(fresh)
                fresh, tokens = [], 0
                packer.fill(pool.low)
                if len(out[0]) >= 4096:
                    yield from flush()
    packer.add(fresh)
    packer.finish()
    yield from flush()


def _kept(keep: list[str], with_ids: bool) -> list[str]:
    """The columns to carry: one named like an added column gives way to it."""
    added = {x.split()[0] for x in PIECES.split(", ")} | ({"ids"} if with_ids else set())
    return [c for c in dict.fromkeys(keep) if c not in added]


def _packed(df: DataFrame, read: Callable, keep: list[str], limits: Limits, pool: Pool, with_ids: bool, **inputs: str) -> DataFrame:
    carried = _kept(keep, with_ids)
    places = [f"k{i}" for i in range(len(carried))]
    added = PIECES + ", ids array<int>" * with_ids
    schema = ", ".join([*(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(places, carried)), added])
    made = by_place(df, carried, **inputs).mapInArrow(lambda it: _pack(it, read, limits, pool, places, with_ids), schema)
    return made.toDF(*carried, *made.columns[len(carried) :])


def pack_examples(df: DataFrame, ids: str, *, keep: list[str], loss: str | None = None, limits: Limits = Limits(), pool: Pool = Pool(), with_ids: bool = True) -> DataFrame:  # noqa: B008
    """Pack tokenised examples.

    ``ids`` is an array<int> column, ``loss`` an array of 0/1 of the same length
    that marks the tokens which bear loss (all, if not given); ``keep`` names
    the columns that identify an example and are carried to its pieces.

    Returns a row per piece: the kept columns, ``start`` and ``length`` within
    the example, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    in the sequence, ``loss_tokens``, and ``ids`` if asked for.  Null or empty
    ids give no piece; repeated rows are packed each for itself; null loss
    entries bear no loss; a kept column named like an added one is replaced by it.
    """
    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        lists, marks = batch.column("given"), batch.column("marks") if loss else None
        for i in range(batch.num_rows):
            values = lists[i].values
            own = np.zeros(0, "<u4") if values is None else values.fill_null(0).to_numpy(zero_copy_only=False).astype("<u4")
            sums = None
            if marks is not None:
                bears = np.zeros(len(own), np.int64)
                if (given := marks[i].values) is not None:
                    got = given.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)[: len(own)]
                    bears[: len(got)] = got != 0
                sums = np.concatenate([[0], np.cumsum(bears)])
            yield own, sums

    return _packed(df, read, keep, limits, pool, with_ids, given=ids, **({"marks": loss} if loss else {}))


# --- texts -------------------------------------------------------------------

#: The pre-tokenizer's pattern (a fixed value), over printable ASCII and the small letters of Latin-1.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: The byte-level model's character for each byte (a fixed value): the byte's own if that can be seen, or else the next free one from U+0100 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
_BYTES = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN and b != 32 else chr(b) for b in range(256))


#: What a byte is to the pattern: white space, a letter, something else that stands for itself, or (digits, apostrophes and the rest) what the pattern has to see with its word.
_SPACE, _LETTER, _SIGN, _WHOLE = range(4)
_KINDS = np.full(256, _WHOLE, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[33:127] = _SIGN
_KINDS[[39, *range(48, 58), *range(65, 91)]] = _WHOLE
_KINDS[97:123] = _LETTER


def _pieces(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Words of the rows of a UTF-8 buffer, cut where letters meet signs unless the row is to be ``whole`` or a byte of the word is; where each row's pieces start."""
    kinds = _KINDS[data]
    # Latin-1's small letters but for the division sign.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[lead + 1]
    lead = lead[(follow >= 0x9F) & (follow != 0xB7)]
    kinds[lead] = kinds[lead + 1] = _LETTER
    solid = kinds != _SPACE
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = solid[edges]
    if whole.any():
        kinds[np.repeat(whole, np.diff(offsets))] = _WHOLE
    rows = np.concatenate([[0], np.cumsum(solid)])[offsets]
    data, kinds, start = data[solid], kinds[solid], start[solid]
    words = np.flatnonzero(start)
    if len(words):
        plain = np.maximum.reduceat(kinds, words) < _WHOLE
        start[1:] |= (kinds[1:] != kinds[:-1]) & np.repeat(plain, np.diff(words, append=len(data)))[1:]
    starts = np.flatnonzero(start)
    ends = np.append(starts, len(data))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)), np.searchsorted(starts, rows)


class WordEncoder:
    """Token ids of texts by a word-level tokenizer, remembering the ids of words.

    For a vocabulary whose pre-tokenizer drops white space and never joins
    characters across it, the ids of a text are those of its words, one after
    another; a word of small letters and signs is cut where these meet, so that
    what is remembered does not depend on the signs around it.  Other words of plain characters are cut by the pre-tokenizer's pattern
    and go to the tokenizer's model in bulk; all others go through the whole
    tokenizer one by one, and so do the words of a text that may hold a special
    token or a combining mark, whose letters are not touched before.  The memory
    holds ``most`` words and is emptied when full.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError(f"{path} marks no word ends")
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        #: The model alone, behind a cut at blanks.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> None:
        known, cut, other, need = self.known, [], [], []
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                need.append(w)
            elif "<|" not in w and _PLAIN.fullmatch(lower := w.lower()):
                pieces = _PIECE.findall(lower)
                cut.append((w, pieces))
                need += pieces
            else:
                other.append(w)
        new = [p for p in dict.fromkeys(need) if p not in known]
        for at in range(0, len(new), 8192):
            chunk = new[at : at + 8192]
            joined = " ".join(chunk)
            if not joined.isascii():
                joined = codecs.charmap_decode(joined.encode(), "strict", _BYTES)[0]
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            edges = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            for p, i, j in zip(chunk, edges[:-1], edges[1:], strict=True):
                known[p] = data[i:j]
        for at in range(0, len(other), 8192):
            chunk = other[at : at + 8192]
            for w, got in zip(chunk, self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False), strict=True):
                known[w] = np.array(got.ids, "<u4").tobytes()
        for w, pieces in cut:
            known[w] = b"".join([known[p] for p in pieces])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column, as little-endian unsigned 32-bit integers; null counts as empty."""
        data, offsets = _text.utf8(texts)
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
        # U+0300 to U+037F: marks that may merge with a letter before it is made small.
        marks = np.concatenate([[0], np.cumsum((data == 0xCC) | (data == 0xCD))])
        raw = pc.or_(pc.match_substring(texts, "<|"), pa.array(marks[offsets[1:]] > marks[offsets[:-1]]))
        pieces, rows = _pieces(*_text.utf8(pc.if_else(raw, texts, pc.ascii_lower(texts))), raw.to_numpy(zero_copy_only=False))
        found = pieces.dictionary_encode()
        index = found.indices.to_numpy()
        with _text.paused_gc():
            distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            missing = [w for w in distinct if w not in self.known]
            if len(self.known) + len(missing) > self.most:
                self.known, missing = {"": b""}, distinct
            if missing:
                self._learn(missing)
            ids = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        sizes, starts = sizes[index], starts[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = table[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        edges = ends[rows].tolist()
        for a, b in zip(edges, edges[1:]):
            yield flat[a:b]


_ENCODERS: dict[str, WordEncoder] = {}


def pack_texts(df: DataFrame, text: str, *, keep: list[str], vocabulary: str | None = None, end_id: int | None = 2, limits: Limits = Limits(), pool: Pool = Pool(), with_ids: bool = False) -> DataFrame:  # noqa: B008
    """Tokenise a text column and pack it; every token bears loss.

    ``vocabulary`` is the tokenizer file's path on the executors (by default
    word_bpe_49k.json of the installed public tokenizers), ``end_id`` is put
    behind each text.  A null text counts as empty, so it has the end id alone.
    Result and edge cases as in :func:`pack_examples`.
    """

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        import public_tokenizers

        path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        column, end = batch.column("given"), np.array([] if end_id is None else [end_id], "<u4")
        sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column).fill_null(0)))])
        at = 0
        while at < batch.num_rows:
            # Some MB of text at a time, a text at least.
            last = max(at + 1, int(np.searchsorted(sizes, sizes[at] + 2_000_000, "right")) - 1)
            for ids in _ENCODERS[path].encode(column.slice(at, last - at)):
                yield np.concatenate([ids, end]), None
            at = last

    return _packed(df, read, keep, limits, pool, with_ids, given=text)


def conversation_examples(conversations: DataFrame, encode: Callable[[Column], Column], *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bears: str = "assistant") -> DataFrame:
    """Instruction examples for :func:`pack_examples`: a row per conversation with ``ids`` and ``loss``.

    Turns are joined in order (equal turns by text); the tokens of role
    ``bears`` bear loss.  ``encode`` turns a text column into an array<int>.
    A conversation is one example and so bounded by its own turns.
    """
    turns = conversations.select(conversation, F.struct(turn, text, F.col(role).eqNullSafe(bears).alias("bears"), encode(F.coalesce(text, F.lit(""))).alias("ids")).alias("t"))
    joined = turns.groupBy(conversation).agg(F.sort_array(F.collect_list("t")).alias("t"))
    return joined.select(
        conversation,
        F.flatten(F.transform("t", lambda x: x["ids"])).alias("ids"),
        F.flatten(F.transform("t", lambda x: F.transform(x["ids"], lambda _: x["bears"].cast("int")))).alias("loss"),
    )
