"""Hierarchical packing of token sequences into windows of several lengths.

Every task packs the documents of its part of the input: whole long windows leave at once, what remains of a document goes
to the tier of its size, gaps of long windows are filled from shorter tiers, and each tier's backlog leaves in windows that
are full. Windows are put into step groups of equal size. A task holds a bounded backlog.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from veridoc.llm.common import slices, to_python
from veridoc.llm.tokens import default_tokenizer, encoder

#: Window lengths; each is a power of two, the last is the long one.
TIERS = (256, 512, 1024, 2048)
#: Long windows per step group.
STEP_WINDOWS = 16
# Windows of a short tier that wait for gaps, and long windows that wait for pieces to fill them.
_BACKLOG = 8
_OPEN = 64
_SEQUENCES_PER_TASK = 1 << 36

Piece = tuple[int | None, int, np.ndarray, int]  # document, start in it, ids, ids of the document


class Packer:
    """Packs documents one after another; `emit` hands out (pieces, window length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
            raise ValueError("tiers are ascending powers of two")
        self.short, self.long = tiers[:-1], tiers[-1]
        self.waiting: dict[int, deque[Piece]] = {t: deque() for t in self.short}
        self.tokens = dict.fromkeys(self.short, 0)
        self.open: deque[tuple[list[Piece], int]] = deque()  # (pieces, gap)
        self.done: list[tuple[list[Piece], int]] = []

    def emit(self) -> list[tuple[list[Piece], int]]:
        done, self.done = self.done, []
        return done

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.long:
            self.done.append(([(doc, at, ids[at:at + self.long], n)], self.long))
            at += self.long
        if at < n:
            self._route((doc, at, ids[at:], n))
        self._settle()

    def _route(self, piece: Piece) -> None:
        size = len(piece[2])
        tier = next((t for t in self.short if size <= t), None)
        if tier is None:
            self.open.append(([piece], self.long - size))
        else:
            self.waiting[tier].append(piece)
            self.tokens[tier] += size

    def _take(self, room: int) -> Piece | None:
        """A waiting piece of at most `room` ids: the largest tier's that fits whole, else the start of one that is cut."""
        cut = None
        for t in reversed(self.short):
            if self.waiting[t]:
                if len(self.waiting[t][0][2]) <= room:
                    piece = self.waiting[t].popleft()
                    self.tokens[t] -= len(piece[2])
                    return piece
                cut = t
        if cut is None:
            return None
        doc, start, ids, n = self.waiting[cut].popleft()
        self.tokens[cut] -= len(ids)
        self._route((doc, start + room, ids[room:], n))
        return doc, start, ids[:room], n

    def _settle(self) -> None:
        while self.open:
            pieces, gap = self.open[0]
            while gap and (piece := self._take(gap)) is not None:
                pieces.append(piece)
                gap -= len(piece[2])
            if gap:
                self.open[0] = (pieces, gap)
                if len(self.open) <= _OPEN:
                    break
                self._break_up()
            else:
                self.done.append((pieces, self.long))
                self.open.popleft()
        for t in self.short:
            while self.tokens[t] >= _BACKLOG * t:
                self._window(t)

    def _break_up(self) -> None:
        """No short piece is there: the newest long window's pieces become fillers."""
        for doc, start, ids, n in self.open.pop()[0]:
            for at in range(0, len(ids), self.short[-1]):
                self._route((doc, start + at, ids[at:at + self.short[-1]], n))

    def _window(self, t: int) -> None:
        """A full window from the backlog of one tier."""
        pieces, room = [], t
        while room:
            doc, start, ids, n = self.waiting[t].popleft()
            self.tokens[t] -= len(ids)
            pieces.append((doc, start, ids[:room], n))
            if len(ids) > room:
                self._route((doc, start + room, ids[room:], n))
            room -= len(pieces[-1][2])
        self.done.append((pieces, t))

    def finish(self) -> None:
        """What is left is laid end to end and cut into long windows, the rest into windows of powers of two."""
        left = [p for pieces, _ in self.open for p in pieces] + [p for t in self.short for p in self.waiting[t]]
        total = sum(len(p[2]) for p in left)
        sizes = [self.long] * (total // self.long) + [1 << b for b in reversed(range(self.long.bit_length())) if total % self.long >> b & 1]
        queue = deque(left)
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, ids, n = queue.popleft()
                pieces.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    queue.appendleft((doc, start + room, ids[room:], n))
                room -= len(pieces[-1][2])
            self.done.append((pieces, size))
        self.open.clear()
        for t in self.short:
            self.waiting[t].clear()
            self.tokens[t] = 0


class Steps:
    """Step groups of `capacity` ids; a window goes to the first open group with room for it."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.next = capacity, {}, 0

    def place(self, window: int) -> int:
        group = next((g for g, room in self.room.items() if room >= window), None)
        if group is None:
            group, self.next = self.next, self.next + 1
            self.room[group] = self.capacity
        self.room[group] -= window
        if not self.room[group]:
            del self.room[group]
        return group


SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, "
          "step_group long")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text",
         tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """One row per piece: its document, place and ids (unsigned 32-bit, little-endian), sequence, window and step group.

    Null texts count as empty and have the end id only; null keys stay null; repeated rows are documents of their own;
    an empty table gives no piece. Very long texts are cut into windows as they come. Other columns are not read.
    Each task's last windows may be shorter powers of two, so that no window has padding.
    """
    tokenizer = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, packer, steps = encoder(tokenizer), Packer(tiers), Steps(step_windows * tiers[-1])
        base = TaskContext.get().partitionId() * _SEQUENCES_PER_TASK
        end, sequence = np.array([end_id], dtype=tool.dtype).tobytes(), base

        def rows() -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for pieces, window in packer.emit():
                offset, group = 0, base + steps.place(window)
                for doc, start, ids, n in pieces:
                    out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, sequence, offset, window, group))
                    offset += len(ids)
                sequence += 1
            columns = list(zip(*out)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1).to_pylist())):
                packer.add(doc, np.frombuffer(ids + end, dtype=tool.dtype))
            yield rows()
        packer.finish()
        yield rows()

    source = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return to_python(source).mapInArrow(run, SCHEMA)
