"""Byte-level BPE by a tree reduction over a monoid.

An encoding is valid exactly if each two neighbouring tokens are what BPE makes
of their joined bytes. So encodings form a monoid: to join two, only the border
can be wrong. A piece is halved down to a few bytes, the halves are encoded, and
a join encodes a window around the border anew, twice as wide each time, until
both its edges make valid neighbours with the tokens outside. These then can't
change. Decoding concatenates tokens, and the blocks of tokens up the tree.

Texts are split by the pattern first, and each match is encoded separately; a
single space before a word starts a match, so that words are looked up by the
space. Encoding and decoding are row-local.

Defined results: null and empty texts have no tokens; a null id stays null;
repeated rows are encoded each; texts and matches of any length are whole.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.plans.arrow import giving_back, map_rows, no_cycles, slices

#: Bytes that are merged directly at the leaves, entries kept of each store, tokens joined at a leaf of decoding.
LEAF, KEPT, BLOCK = 4, 300_000, 4096
_SPACES = re.compile(r"\s\s").search


class ByteBPE:
    """BPE with the ranks of a ``.tiktoken`` file and a pattern that splits texts."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: x for x, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.trees: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """BPE by its definition: of all neighbours the pair of lowest rank, leftmost first, is merged."""
        if len(piece) > 48:
            return self._merge_long(piece)
        ranks, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 60
        costs = [ranks(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while costs:
            low = min(costs)
            if low == none:
                break
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = ranks(parts[i] + parts[i + 1], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, for long windows."""
        n = len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return tuple(self.ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the joined bytes of two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return known

    def neighbours(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side."""
        return self.pair(a, b) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        i, j, width = len(left) - 1, 1, 1
        window = self.pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        while True:
            if (i == 0 or self.neighbours(left[i - 1], window[0])) and (j == len(right) or self.neighbours(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))

    def tree(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of ``piece`` by halves."""
        known = self.trees.get(piece)
        if known is not None:
            return known
        n = len(piece)
        found = self.merge(piece) if n <= LEAF else self.join(self.tree(piece[: n // 2]), self.tree(piece[n // 2 :]))
        if n <= 8:
            if len(self.trees) >= KEPT:
                self.trees.clear()
            self.trees[piece] = found
        return found

    def piece(self, match: str) -> bytes:
        """Ids of one match of the pattern, as 32-bit bytes; a match that is a token is that token."""
        known = self.pieces.get(match)
        if known is None:
            raw = match.encode()
            whole = self.ranks.get(raw)
            known = np.array(self.tree(raw) if whole is None else (whole,), "<i4").tobytes()
            if len(match) <= 64:
                if len(self.pieces) >= KEPT:
                    self.pieces.clear()
                self.pieces[match] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit bytes."""
        if _SPACES(text) is not None:
            return b"".join(map(self.piece, self.split(text)))
        first, *rest = text.split(" ")
        words, out = self.words, [b"".join(map(self.piece, self.split(first)))]
        for word in rest:
            known = words.get(word)
            if known is None:
                known = b"".join(map(self.piece, self.split(" " + word)))
                if len(word) <= 64:
                    if len(words) >= KEPT:
                        words.clear()
                    words[word] = known
            out.append(known)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``, by halves; KeyError for an id that has none."""
        if len(ids) > BLOCK:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` as rows (id, ids)."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    kind = to_arrow_schema(schema).field("ids").type

    def make():
        bpe = ByteBPE(vocabulary, pattern)

        def work(ids, texts):
            found = [bpe.encode(x or "") for x in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            return {"id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")), type=kind)}

        return work

    return map_rows(df.select(id_col, text_col), make, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Rows of ``encode`` with their bytes: (id, ids, content). Null ids: no bytes."""
    schema = T.StructType([*encoded.select("id", "ids").schema, T.StructField("content", T.BinaryType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(vocabulary, pattern)
        for whole in batches:
            for batch in slices(whole):
                with no_cycles():
                    lists = batch.column(1)
                    ends = lists.offsets.to_pylist()
                    values = lists.values.to_numpy(zero_copy_only=False)
                    found = [bpe.decode(values[i:j].tolist()) for i, j in zip(ends, ends[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), lists.cast(target.field(1).type), pa.array(found, pa.binary())], schema=target)

    return encoded.select("id", "ids").mapInArrow(giving_back(run), schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded, as digests."""
    import public_tokenizers

    given = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *given), *given)
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )
