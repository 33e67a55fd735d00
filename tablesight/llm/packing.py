"""Best-fit packing with certified partition bounds.

Documents are tokenised in parallel and cut into pieces of at most ``capacity``
tokens (only longer documents are cut; the remainder is the first piece). Pieces are
dealt at random to partitions of a bounded expected size. Each partition runs
best-fit decreasing and compares its bin count with a lower bound from
dual-feasible functions. A partition that meets its bound is certified and closes
its bins but the emptiest; one with a gap gives up all its bins that are not full.
The given-up pieces are dealt again, from all partitions together, and packed anew.
In the last round all bins stay.

Nulls, empties, ties: a null text counts as empty, and an empty document is one piece
that holds the end token alone. Repeated rows are packed as often as they occur (a row
number of its own tells them apart). An empty table gives an empty table. Extra
columns of the input are left out unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, frames, parts_for, text_or_empty
from .tokenization import encode_ids


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an ``n``-token document: all but the first are full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_json: str, ranks: str | None = None, pattern: str | None = None,
                 capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids) with ``ids`` as the bytes
    of unsigned little-endian 32-bit token ids."""
    end = np.array([end_id], dtype="<u4")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(it):
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.concatenate([encode_ids(text, tokenizer_json, ranks, pattern), end])
                out += [(doc, i, s, n, ids[s:s + n].tobytes())
                        for i, (s, n) in enumerate(cut_points(len(ids), capacity))]
            res = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])
            res["doc_id"] = res["doc_id"].astype(pdf["doc_id"].dtype)
            yield res

    id_type = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    if isinstance(id_type, T.IntegralType):
        # a null id would turn the frame's ids into floats; it travels as text
        src = src.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return src.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of several dual-feasible functions.

    f_t keeps a size, counts sizes above ``capacity - t`` as a whole bin and those
    below ``t`` as nothing; u_k rounds (k+1)x down to a multiple of 1/k. The sum of
    such values never exceeds the number of bins."""
    if len(lengths) == 0:
        return 0
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    cnt, tot = np.cumsum(hist), np.cumsum(hist * sizes)
    t = np.arange(0, capacity // 2 + 1)
    below_t = np.where(t > 0, tot[t - 1], 0)
    value = (cnt[-1] - cnt[capacity - t]) * capacity + (tot[capacity - t] - below_t)
    best = int(-(-value.max() // capacity))
    for k in range(1, 21):
        whole = (sizes * (k + 1)) % capacity == 0
        # u_k scaled by k * capacity, so that all values stay whole numbers
        u = np.where(whole, sizes * k, (sizes * (k + 1) // capacity) * capacity)
        best = max(best, int(-(-int((u * hist).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length and the free room of each bin. Equal lengths keep
    their order; among equally good bins the latest one is taken."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []  # ``rooms``: bit r is set where a bin with room r exists
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bin_of[i], offset[i] = b, capacity - room
        free[b] = left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return bin_of, offset, np.array(free, dtype=np.int64)


def _pack_partition(capacity: int, base: int, last: bool):
    """The function for one partition of pieces; ``base`` tells the rounds' sequences apart."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        bins, offset, free = best_fit_decreasing(lengths, capacity)
        if last:
            gives = np.zeros(len(free), bool)
        elif len(free) > lower_bound(lengths, capacity):
            gives = free > 0
        else:
            gives = (np.arange(len(free)) == int(free.argmax())) & (free > 0)
        return pdf.drop(columns="__part").assign(sequence_id=base + (int(key[0]) << 28) + bins, offset=offset, __open=gives[bins])

    return one


def pack(pieces: DataFrame, capacity: int = 1024, rounds: int = 3, per_partition: int = 4096,
         keep: Sequence[str] = ("doc_id", "piece", "start")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``.

    ``keep`` names the columns that travel with a piece. Full pieces are sequences of
    their own and are not shuffled."""
    cols = [*keep, "length"]
    rows = cut(pieces.select(*cols).withColumn("__uid", F.monotonically_increasing_id()))
    whole = rows.filter(F.col("length") >= capacity).select(
        *cols, (-F.col("__uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < capacity)
    done, n = [whole], rest.count()
    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("__open", T.BooleanType())])
    for r in range(rounds):
        if n == 0:
            break
        last = r == rounds - 1
        parts = parts_for(n, per_partition)
        dealt = rest.withColumn("__part", F.pmod(F.xxhash64(F.col("__uid"), F.lit(r)), F.lit(parts)))
        out = cut(dealt.groupBy("__part").applyInPandas(_pack_partition(capacity, r << 56, last), schema))
        done.append(out.filter(~F.col("__open")).select(*cols, "sequence_id", "offset"))
        rest = out.filter("__open").select(*cols, "__uid")
        n = rest.count() if not last else 0
    res = done[0]
    for d in done[1:]:
        res = res.unionByName(d)
    return res


def pack_documents(docs: DataFrame, tokenizer_json: str, ranks: str | None = None, pattern: str | None = None,
                   capacity: int = 1024, end_id: int = 2, with_ids: bool = True, **kw) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place. ``with_ids`` keeps the
    token ids themselves; their CRC-32 is always given."""
    pieces = token_pieces(docs, tokenizer_json, ranks, pattern, capacity, end_id, **kw)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    keep = ["doc_id", "piece", "start", "ids_crc32", *(["ids"] if with_ids else [])]
    return pack(pieces, capacity, keep=keep)
