"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an arc for every vocabulary piece at every place.
With a BPE vocabulary two pieces may follow each other only if merging their
joined characters gives back just these two, and a segmentation is the
encoding exactly if all its neighbours may follow each other; so of the arcs
that end at a place one survives, and the search yields the ids of the
SentencePiece library itself.

The search goes from left to right.  Places further back than the longest
piece cannot be reached any more; as soon as the backpointer paths of all
places within reach meet in one boundary, the ids up to it are final and are
given out.  A character outside the vocabulary, and a space behind a character
that no piece continues across, is such a boundary at once; the stretches
between these are short, repeat a lot, and are remembered.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm._sql import by_place
from tidepool.llm._text import paused_gc

#: SentencePiece's mark for a space.
SPACE = "▁"
_MARKS = ",.;:!?%&*$#|()"
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n")


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.rank, self.bytes = {}, {}, {}
        self.table: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.table.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i):
                self.table.append(b"")
            elif model.is_unknown(i):
                self.table.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.rank[piece] = i, -model.get_score(i)
                self.table.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        #: Whether a space may only begin a piece, and newlines stand outside all: then both cut a text into stretches.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        #: Neighbouring characters within some piece; between any others all encodings have a boundary.
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Pieces that merging makes at all, and the ends of these.
        self.whole = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.endings = {p[i:] for p in self.whole for i in range(len(p))}
        # Of such pieces with a rank of their own: the pieces at their two ends, from the whole down to a character, with the ranks.
        shared = {r for r, n in Counter(self.rank.values()).items() if n > 1}
        self.heads: dict[str, list[tuple[str, float]]] = {}
        self.tails: dict[str, list[tuple[str, float]]] = {}
        for piece in sorted(self.whole, key=len):
            parts = self.merge(piece, 2)
            if len(piece) == 1:
                self.heads[piece] = self.tails[piece] = [(piece, -1.0)]
            elif self.rank[piece] not in shared and all(x in self.heads and (len(x) == 1 or self.rank[x] < self.rank[piece]) for x in parts):
                self.heads[piece] = [(piece, self.rank[piece]), *self.heads[parts[0]]]
                self.tails[piece] = [(piece, self.rank[piece]), *self.tails[parts[1]]]
        self.follow: dict[tuple[str, str], bool] = {}

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair merging by the definition, down to ``least`` parts: always the leftmost adjacent pair whose union ranks best."""
        parts = list(text)
        while len(parts) > least:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str | None, b: str | None) -> bool:
        """Whether merging the characters of two pieces leaves them as they are; None is a character outside the vocabulary, or a text's edge.

        Goes back through the merges that made the two: of any two parts that
        ever stood at the boundary, the union must not have been due before
        the merge that took either of them away (equal ranks: leftmost first).
        """
        if a is None or b is None:
            return True
        if a not in self.tails or b not in self.heads:
            return self.merge(a + b) == [a, b]
        left, right, i, j = self.tails[a], self.heads[b], 0, 0
        gone_left = gone_right = np.inf
        while True:
            rank = self.rank.get(left[i][0] + right[j][0])
            if rank is not None and rank < gone_left and rank <= gone_right:
                return False
            if left[i][1] > right[j][1]:
                gone_left = left[i][1]
                i += 1
            elif right[j][1] >= 0:
                gone_right = right[j][1]
                j += 1
            else:
                return True


class StreamingEncoder:
    """Viterbi search over text that comes in parts; ids are given out when they are final.

    Spaces must have become :data:`SPACE` before.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.text, self.done = vocabulary, "", 0
        #: For each place from ``done`` on: where its last piece starts (-1: the place is no boundary of any encoding), and that piece.
        self.start, self.piece = [0], [None]

    def feed(self, text: str, *, last: bool = False) -> list[int]:
        """Take more text; returns ids that no further text can change."""
        self.text += text
        out: list[int] = []
        while len(self.start) <= len(self.text):
            self._extend(min(len(self.text), 4 * self.v.longest))
            if len(self.start) > 4 * self.v.longest:
                out += self._commit(self._meeting())
        if last:
            out += self._commit(len(self.text))
        return out

    def _extend(self, end: int) -> None:
        """Find the surviving arc of each further place up to ``end``, one at least."""
        text, start, piece, v = self.text, self.start, self.piece, self.v
        endings, whole, follow = v.endings, v.whole, v.follow
        for place in range(len(start), max(end, len(start)) + 1):
            at = place - 1
            part = text[at:place]
            while part in endings:
                if part in whole and start[at] >= 0:
                    before = piece[at]
                    ok = before is None or follow.get((before, part))
                    if ok is None:
                        if len(follow) > 600_000:
                            follow.clear()
                        ok = follow[before, part] = v.may_follow(before, part)
                    if ok:
                        start.append(at)
                        piece.append(part)
                        break
                at -= 1
                if at < 0:
                    part = ""
                    break
                part = text[at:place]
            else:
                part = ""
            if not part:
                # A character outside the vocabulary is a piece of its own.
                start.append(place - 1)
                piece.append(None)

    def _meeting(self) -> int:
        """The last boundary on the paths of all places that a further piece can start from."""
        places = {p for p in range(max(0, len(self.start) - self.v.longest), len(self.start)) if self.start[p] >= 0}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(self.start[last])
        return places.pop()

    def _commit(self, to: int) -> list[int]:
        """Ids up to a boundary; what lies before it is forgotten."""
        path, at = [], to
        while at > 0:
            piece = self.piece[at]
            if piece is None:
                path += [self.v.bytes[b] for b in reversed(self.text[self.start[at] : at].encode())]
            else:
                path.append(self.v.ids[piece])
            at = self.start[at]
        if to:
            self.text = self.text[to:]
            self.start = [0, *(s - to if s >= to else -1 for s in self.start[to + 1 :])]
            self.piece = [self.piece[to], *self.piece[to + 1 :]]
            self.done += to
        return path[::-1]


class TextCoder:
    """Ids of whole texts and back, remembering up to ``most`` stretches."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        self.v, self.most = Vocabulary(path), most
        self.known: dict[str, bytes] = {"": b""}

    def _search(self, stretch: str, size: int = 4096) -> bytes:
        encoder, ids = StreamingEncoder(self.v), []
        for at in range(0, len(stretch), size):
            ids += encoder.feed(stretch[at : at + size], last=at + size >= len(stretch))
        return (array("I", ids) if sys.byteorder == "little" else np.array(ids, "<u4")).tobytes()

    def _learn(self, stretch: str) -> None:
        """Remember a stretch; marks at its end that no piece joins to what is before serve other stretches too."""
        known, stem = self.known, stretch.rstrip(_MARKS)
        if 0 < len(stem) < len(stretch) and stretch[len(stem) - 1 : len(stem) + 1] not in self.v.inner:
            for part in (stem, stretch[len(stem) :]):
                if part not in known:
                    known[part] = self._search(part)
            known[stretch] = known[stem] + known[stretch[len(stem) :]]
        else:
            known[stretch] = self._search(stretch)

    def stretches(self, text: str) -> list[str]:
        """The text in parts that are encoded independently of each other."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.v.cuts:
            return [marked]
        apart = marked.replace(SPACE, " " + SPACE).replace("\n", " \n ")
        parts = apart.split(" ")
        # A run of spaces may be one piece, and begins the stretch behind it.
        return _STRETCH.findall(marked) if SPACE in parts else parts

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        with paused_gc():
            split = [self.stretches(t) for t in texts]
            missing = set().union(*split) - self.known.keys() if split else set()
            if len(self.known) + len(missing) > self.most:
                self.known = {"": b""}
                missing = set().union(*split) - {""}
            for part in missing:
                self._learn(part)
        get = self.known.__getitem__
        for parts in split:
            yield np.frombuffer(b"".join(map(get, parts)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        text = b"".join(map(self.v.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODERS: dict[str, TextCoder] = {}


def _coder(path: str | None) -> TextCoder:
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _CODERS:
        _CODERS[path] = TextCoder(path)
    return _CODERS[path]


def _carried(df: DataFrame, keep: list[str], added: str, run: Callable, given: str) -> DataFrame:
    """The kept columns, but for those named like added ones, and what ``run`` makes of ``given`` and them."""
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in {x.split()[0] for x in added.split(", ")}]
    schema = ", ".join([*(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), added])
    made = by_place(df, kept, given=given).mapInArrow(lambda it: run(it, [f"k{i}" for i in range(len(kept))]), schema)
    return made.toDF(*kept, *made.columns[len(kept) :])


def encode(df: DataFrame, text: str = "text", *, keep: list[str], model: str | None = None, with_ids: bool = True, check: bool = False) -> DataFrame:
    """The kept columns of every row with ``n_ids``, ``ids_crc32`` (of little-endian unsigned 32-bit ids) and ``n_byte_ids``.

    ``with_ids`` adds ``ids``; ``check`` adds ``exact``: whether decoding gives
    the text again (U+2581 in a text comes back as a space).  ``model`` is the path of a SentencePiece BPE model on
    the executors.  A null or empty text has no ids.  A map without a shuffle;
    each row, repeated or not, stands for itself.  A kept column named like an
    added one is replaced by it.
    """

    def run(batches: Iterable[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        byte_ids = np.array(sorted(coder.v.bytes.values()), "<u4")
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, first = [], 0, at
                while at < batch.num_rows and (not texts or size < 2_000_000 and len(texts) < 512):
                    texts.append(batch.column("given")[at].as_py() or "")
                    size, at = size + len(texts[-1]), at + 1
                ids = list(coder.encode(texts))
                out = {c: batch.column(c).slice(first, at - first) for c in kept}
                out["n_ids"] = pa.array([len(x) for x in ids], pa.int64())
                out["ids_crc32"] = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
                out["n_byte_ids"] = pa.array([int(((x >= byte_ids[0]) & (x <= byte_ids[-1])).sum()) if len(byte_ids) else 0 for x in ids], pa.int64())
                if check:
                    out["exact"] = pa.array([coder.decode(x) == t for x, t in zip(ids, texts, strict=True)])
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    added = "n_ids long, ids_crc32 long, n_byte_ids long" + ", exact boolean" * check + ", ids array<int>" * with_ids
    return _carried(df, keep, added, run, text)


def decode(df: DataFrame, ids: str = "ids", *, keep: list[str], model: str | None = None) -> DataFrame:
    """The kept columns of every row with ``text``, the decoded ids; null ids give an empty text, null entries nothing; a kept column called text is replaced."""

    def run(batches: Iterable[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [coder.decode(np.array([i for i in x.as_py() or [] if i is not None], np.int64)) for x in part.column("given")]
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in kept}, "text": pa.array(texts, pa.string())})

    return _carried(df, keep, "text string", run, ids)
