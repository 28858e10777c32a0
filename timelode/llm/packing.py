"""Best-fit packing into sequences of several permitted lengths.

Documents are measured in words. One longer than the largest length is cut into pieces of that length and
a rest; nothing is dropped. Pieces are packed in shards of at most `shard_pieces` consecutive pieces of an
input partition, so packing needs no shuffle and memory is bounded by a shard. Of an input that is sorted
as a whole the order is carried on, if asked for: shards are numbered along it, and the bins of a shard by
the average place of their words in it. In a shard pieces go, longest first, to the open bin that they fill best; where
none has room a new one is opened, at the permitted length that costs least a word when it is filled with the
pieces that follow. At the end every bin is downsized to the smallest permitted length that holds its
contents. Packings that open every bin at one least length are tried as well, and the packing of least
cost is taken, so the lengths are chosen jointly for a shard. A bin costs its length, a
part that grows with the square of the length (attention), and a fixed amount.

Null and empty texts have no words and are one piece of length 0 in a bin of their own shard. Repeated
rows are packed each; pieces of equal length go in the order of the input; an empty table gives no rows.
Bins are named by their partition, their shard's place in it and what the shard holds.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import picked

LENGTHS, SHARD_PIECES, BIN_COST, SQUARE = (256, 512, 1024, 2048, 4096), 4096, 16, 1 / 32_768


def bin_cost_of(length: int, bin_cost: float = BIN_COST) -> float:
    return length + length * length * SQUARE + bin_cost


def fitting(lengths: Sequence[int], words: int) -> int:
    return lengths[bisect_left(lengths, words)]


def cheapest_opening(falling: Sequence[int], at: int, lengths: Sequence[int], bin_cost: float) -> int:
    """The length to open a bin of for the piece at `at` of pieces in falling order (as negative sizes): that of least cost a word.

    Each length is tried by filling it, longest first, with the pieces that follow.
    """
    best, chosen = float("inf"), lengths[-1]
    for length in lengths[bisect_left(lengths, -falling[at]) :]:
        words, next_one = -falling[at], at + 1
        while words < length and (next_one := bisect_left(falling, words - length, next_one)) < len(falling) and falling[next_one]:
            words -= falling[next_one]
            next_one += 1
        cost = bin_cost_of(fitting(lengths, words), bin_cost) / max(words, 1)
        if cost < best:
            best, chosen = cost, length
    return chosen


def best_fit(sizes: Sequence[int], lengths: Sequence[int], least: int | None = None, bin_cost: float = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the downsized length of each bin.

    Bins are opened at the length of least cost, bin by bin, or else at the first length of at least `least`.
    """
    bins, offsets, used, room = [0] * len(sizes), [0] * len(sizes), [], []
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    falling = [-sizes[i] for i in order]
    for place, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            chosen, left = len(used), cheapest_opening(falling, place, lengths, bin_cost) if least is None else max(least, fitting(lengths, size))
            used.append(0)
        bins[i], offsets[i] = chosen, used[chosen]
        used[chosen] += size
        insort(room, (left - size, chosen))
    return bins, offsets, [fitting(lengths, u) for u in used]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """The packing of least cost among bins opened one by one at their cheapest length, and all at the same least length."""
    lengths = sorted(lengths)
    return min((best_fit(sizes, lengths, least, bin_cost) for least in (None, *lengths)), key=lambda x: sum(bin_cost_of(c, bin_cost) for c in x[2]))


_COLUMNS = "piece int, start bigint, length bigint, bin_id string, bin_length int, bin_offset int"


def bin_places(bins: Sequence[int], sizes: Sequence[int]) -> list[int]:
    """Per piece the number of its bin, from 0, in the order of the average place of the bins' words."""
    words, places = [0] * (max(bins) + 1), [0] * (max(bins) + 1)
    for i, (b, n) in enumerate(zip(bins, sizes, strict=True)):
        words[b] += max(n, 1)
        places[b] += max(n, 1) * i
    rank = {b: k for k, b in enumerate(sorted(range(len(words)), key=lambda b: (places[b] / words[b], b)))}
    return [rank[b] for b in bins]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES, bin_cost: int = BIN_COST, ordered: bool = False) -> DataFrame:
    """One row per piece: id, piece number, its first word and length, and the bin, its length and the piece's place in it.

    `ordered`: docs are sorted as a whole (orderBy), and two columns follow. In the order of (shard_place,
    bin_place) the shards are consecutive runs of docs.
    """
    kind, most, lengths = docs.schema[id_col].dataType.simpleString(), max(lengths), tuple(sorted(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shards = count(TaskContext.get().partitionId() << 32)

        def flush(part: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            bins, offsets, sizes = pack([x[3] for x in part], lengths, bin_cost)
            ids, piece, start, length = zip(*part, strict=True)
            shard = next(shards)
            # bins are numbered within a shard; a task run again names its shards alike
            name = uuid.uuid5(uuid.NAMESPACE_OID, f"{shard} {part!r}").hex
            columns = [pa.array(ids, id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            columns += [pa.array([f"{name}-{b}" for b in bins]), pa.array([sizes[b] for b in bins], pa.int32()), pa.array(offsets, pa.int32())]
            names = ["id", "piece", "start", "length", "bin_id", "bin_length", "bin_offset"]
            if ordered:
                columns += [pa.array([shard] * len(part), pa.int64()), pa.array(bin_places(bins, length), pa.int32())]
                names += ["shard_place", "bin_place"]
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            for i in range(batch.num_rows):
                words, key = len((batch.column("text")[i].as_py() or b"").split()), batch.column("id")[i].as_py()
                held += [(key, n, at, min(most, words - at)) for n, at in enumerate(range(0, max(words, 1), most))]
                while len(held) >= shard_pieces:
                    yield flush(held[:shard_pieces], id_type)
                    del held[:shard_pieces]
        if held:
            yield flush(held, id_type)

    return picked(docs, id=id_col, text=F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, f"id {kind}, {_COLUMNS}{', shard_place bigint, bin_place int' if ordered else ''}").withColumnRenamed("id", id_col)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
