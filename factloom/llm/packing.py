"""Packing: documents cut and placed into token sequences by the dot-product heuristic.

A sequence has room in three dimensions: tokens, segments, and tokens that bear
loss. The next example is, of those that fit, the one whose demand has the
largest dot product with the room left (both as shares of the limits); where
none fits whole, the best is cut to fill the sequence. Documents longer than a
sequence first give whole sequences. Each task packs the rows that it reads,
with a bounded number of open examples, so nothing is shuffled and memory does
not grow with the input; at a task's end the last, unfilled sequence is cut
into lengths that are powers of two, which need no padding.

Defined results: a null or empty text is its end token alone; a null id stays
null; repeated rows are packed each; an empty table gives no rows; texts of any
length are cut. A loss column says of a row, or of each of its tokens, whether
it bears loss; null: all do, and tokens beyond its length don't. A piece never
breaks a limit; without any room for loss, what bears it is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.plans.arrow import giving_back, no_cycles, slices
from factloom.llm.words import WordTokens

MAX_TOKENS, MAX_SEGMENTS, END_ID = 2048, 128, 1
#: Examples that wait for a place at most, and at which filling stops.
OPEN, LOW = 768, 384
#: Words that a task keeps the ids of, and bytes of text that it encodes at once: as fast as can be, and in little memory.
FAST, LEAN = (600_000, 8 << 20), (100_000, 1 << 20)


class Packer:
    """Places examples one sequence at a time; ``placed`` collects (key, start, length, sequence, offset)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first: int = 0) -> None:
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.waiting: list[tuple[object, int, int, np.ndarray | None]] = []
        self.demand = np.zeros((OPEN + 8, 3))
        self.open: list[tuple[object, int, int]] = []
        self.used = [0, 0, 0]
        self.sequence = first
        self.placed: list[tuple[object, int, int, int, int]] = []

    @staticmethod
    def _loss(bears: np.ndarray | None, start: int, end: int) -> int:
        return end - start if bears is None else int(bears[end] - bears[start])

    def _reach(self, start: int, end: int, bears: np.ndarray | None, tokens: int, loss: int) -> int:
        """The end of the longest piece from ``start`` within so many tokens and so much loss."""
        end = min(end, start + tokens)
        if bears is None:
            return min(end, start + loss)
        return min(end, int(np.searchsorted(bears, bears[start] + loss, "right")) - 1)

    def add(self, key: object, length: int, bears: np.ndarray | None = None) -> None:
        """An example of so many tokens; ``bears``: loss-bearing tokens before each position, length + 1 values."""
        start = 0
        while length - start >= self.max_tokens:
            end = self._reach(start, length, bears, self.max_tokens, self.max_loss)
            if end - start < self.max_tokens:
                break
            self.placed.append((key, start, end - start, self.sequence, 0))
            self.sequence += 1
            start = end
        while start < length:
            end = self._reach(start, length, bears, self.max_tokens, self.max_loss)
            if end == start:
                raise ValueError("the loss limit is 0")
            self._wait(key, start, end, bears)
            start = end
        if len(self.waiting) >= OPEN:
            self.fill(LOW)

    def _wait(self, key: object, start: int, end: int, bears: np.ndarray | None) -> None:
        if len(self.waiting) == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.waiting)] = (end - start, 1, self._loss(bears, start, end))
        self.waiting.append((key, start, end, bears))

    def _take(self, i: int) -> tuple[object, int, int, np.ndarray | None]:
        """Example ``i``; the last one moves to its place."""
        found, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return found

    def _put(self, key: object, start: int, end: int, bears: np.ndarray | None) -> None:
        self.open.append((key, start, end - start))
        self.used[0] += end - start
        self.used[1] += 1
        self.used[2] += self._loss(bears, start, end)

    def close(self) -> None:
        """End the open sequence."""
        at = 0
        for key, start, length in self.open:
            self.placed.append((key, start, length, self.sequence, at))
            at += length
        self.sequence += bool(self.open)
        self.open, self.used = [], [0, 0, 0]

    def fill(self, low: int) -> None:
        """Fill sequences until no more than ``low`` examples wait."""
        while len(self.waiting) > low:
            room = self.limits - self.used
            if room[0] <= 0 or room[1] <= 0:
                self.close()
                continue
            wanted = self.demand[: len(self.waiting)]
            score = wanted @ (room / self.limits**2)
            fits = (wanted <= room).all(axis=1)
            if fits.any():
                self._put(*self._take(int(np.argmax(np.where(fits, score, -1.0)))))
                continue
            i = int(np.argmax(score))
            key, start, end, bears = self.waiting[i]
            cut = self._reach(start, end, bears, int(room[0]), int(room[2]))
            if cut > start:
                self._take(i)
                self._put(key, start, cut, bears)
                self._wait(key, cut, end, bears)
            self.close()

    def finish(self) -> None:
        """Place all that waits; cut the unfilled last sequence into powers of two."""
        self.fill(0)
        pieces, left = self.open, self.used[0]
        self.open, self.used = [], [0, 0, 0]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            while size:
                key, start, length = pieces[0]
                part = min(size, length)
                self.open.append((key, start, part))
                pieces[0:1] = [(key, start + part, length - part)] if part < length else []
                size -= part
            self.close()


PIECES = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]
)


def pack(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    end_id: int = END_ID,
    keep_ids: bool = True,
    store: tuple[int, int] = FAST,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, piece_ids.

    ``loss_col``: a boolean for the row, or an array with one for each token, the
    end token included; ``keep_ids`` False leaves piece_ids null; ``store``: how
    much a task keeps at hand, with the same result (``FAST``, ``LEAN``).
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *PIECES])
    target = to_arrow_schema(schema)
    most_loss = max_tokens if max_loss is None else max_loss
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary, store[0])
        packer = Packer(max_tokens, max_segments, most_loss, first=TaskContext.get().partitionId() << 33)

        def placed() -> Iterator[pa.RecordBatch]:
            out, packer.placed = packer.placed, []
            if out:
                parts = [memoryview(k[1])[4 * s : 4 * (s + n)] for k, s, n, _, _ in out]
                if keep_ids:
                    ends = np.cumsum([0, *(n for _, _, n, *_ in out)], dtype=np.int32)
                    pieces = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")), type=target.field("piece_ids").type)
                else:
                    pieces = pa.nulls(len(out), target.field("piece_ids").type)
                columns = [
                    [k[0] for k, *_ in out],
                    [s for _, s, *_ in out],
                    [n for _, _, n, *_ in out],
                    [zlib.crc32(x) for x in parts],
                    [len(k[1]) // 4 for k, *_ in out],
                    [q for *_, q, _ in out],
                    [o for *_, o in out],
                ]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, target)), pieces], schema=target)  # noqa: B905

        for whole in batches:
            for batch in slices(whole, store[1]):
                ids, texts, *loss = (c.to_pylist() for c in batch.columns)
                with no_cycles():
                    encoded = [x + end for x in tokens.encode([t or "" for t in texts])]
                for i, (key, x) in enumerate(zip(ids, encoded, strict=True)):
                    bears = None
                    given = loss[0][i] if loss else None
                    if given is False:
                        bears = np.zeros(len(x) // 4 + 1, np.int64)
                    elif given is not None and given is not True:
                        marks = np.zeros(len(x) // 4, np.int64)
                        own = np.array([bool(v) for v in given], np.int64)[: len(marks)]
                        marks[: len(own)] = own
                        bears = np.concatenate([[0], np.cumsum(marks)])
                    packer.add((key, x), len(x) // 4, bears)
                yield from placed()
        packer.finish()
        yield from placed()

    return df.select(id_col, text_col, *([loss_col] if loss_col else [])).mapInArrow(giving_back(run), schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, as digests of the pieces."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(documents, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return pieces.drop("piece_ids").withColumnRenamed("id", "doc_id")


def packing_turns(spark, sf_dir: str) -> DataFrame:
    """The turns of conversations in sequences of at most 2048 tokens, 24 segments and 1024 tokens of the assistant, the only ones that bear loss."""
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select(F.struct("conv_id", "turn").alias("doc_id"), "text", (F.col("role") == "assistant").alias("loss"))
    pieces = pack(rows, public_tokenizers.path("word_bpe_49k.json"), loss_col="loss", max_segments=24, max_loss=1024, keep_ids=False)
    return pieces.select("id.conv_id", "id.turn", *(f.name for f in PIECES if f.name != "piece_ids"))
