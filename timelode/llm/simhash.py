"""SimHash near-duplicates, found through the perfect (23, 12) binary Golay code.

A 64-bit fingerprint is cut into three segments. Fingerprints that differ in at most two bits have one
segment in common, and the segment that follows it (in a circle) differs in at most one bit, or else the
pair of another equal segment does: two of the three segments can't both hold two errors. So one key per
segment is enough: the segment's exact bits with the index of a Golay codeword near the next segment.
Every 23-bit word lies within three bits of exactly one codeword. A *home* row carries the codeword of
the segment itself, *probe* rows those of all words at most one bit away (at most six). Two segments one
bit apart therefore always meet, and joining home to probe rows and counting the differing bits gives
every link.

Equal fingerprints are folded first. A key under which very many different fingerprints meet, at home or as
probes (a large family of near copies), is not joined pairwise: its fingerprints are linked through the 65 words at most
one bit away from each, as two fingerprints differ in at most two bits exactly if they share such a
word. Each word links its fingerprints to the smallest one, so links stay linear and none is lost
between components.

Null and empty texts have fingerprint zero, whatever their number. Repeated rows and rows that share an id
are linked like any other; very long texts are read whole. Rows with a null id get the component of the
rows with their fingerprint, and a null one where no row with an id has it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import picked, save
from timelode.llm.components import connected_components

#: Rows for which keys or shingles are held at a time.
SLICE = 1024

SEED = 42
#: Widths of the segments by radius, from the low bit; each is padded with zeros to 23 bits. Of radius + 1
#: segments in a circle, one is equal and followed by one with at most one differing bit.
WIDTHS = {2: (22, 21, 21), 3: (16, 16, 16, 16)}
#: Generator polynomial of the cyclic (23, 12) Golay code.
GENERATOR = 0b110001110101
#: Home rows of a key beyond which it is crowded, and how many times as many probe rows make it so.
BUCKET_LIMIT, PROBES_A_HOME = 200, 32
BROADCAST_ROWS = 50_000

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256
_BLOCK = 1 << 16


def words_of(text: bytes) -> list[bytes]:
    """ASCII white space cuts words; only A-Z are lower-cased."""
    return text.lower().split()


def simhash(words: list[bytes], shingle: int) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; repeats count."""
    return fingerprint(shingle_hashes(words, shingle)) if words else 0


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words are one shingle."""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros((8, 256))
    for i in range(0, len(hashes), _BLOCK):
        octets = hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BYTE_BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@lru_cache(1)
def decoder() -> np.ndarray:
    """For every 23-bit word the index (message) of the one codeword within three bits."""
    message = np.arange(4096, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    code = message << 11 | rest
    table = np.zeros(1 << 23, dtype=np.uint16)
    ones = [1 << i for i in range(23)]
    table[code] = message
    for i, x in enumerate(ones):
        table[code ^ x] = message
        for j, y in enumerate(ones[:i]):
            table[code ^ x ^ y] = message
            for z in ones[:j]:
                table[code ^ x ^ y ^ z] = message
    return table


def golay_keys(prints: np.ndarray, near: bool, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of int64 fingerprints: home keys, or with `near` those to probe. Keys are below 2 ** 36."""
    table, u, widths = decoder(), prints.view(np.uint64), WIDTHS[radius]
    segments = [((u >> np.uint64(sum(widths[:i]))) & np.uint64((1 << w) - 1)).astype(np.int64) for i, w in enumerate(widths)]
    rows, keys = [], []
    for k in range(len(widths)):
        j = (k + 1) % len(widths)
        flips = np.array([0, *(1 << i for i in range(widths[j]))] if near else [0])
        index = np.sort(table[segments[j][:, None] ^ flips], axis=1)
        first = np.ones(index.shape, dtype=bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, at = np.nonzero(first)
        rows.append(row)
        keys.append(np.int64(k) << 34 | segments[k][row] << 12 | index[row, at].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(words_of(t.as_py() or b""), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], ["id", "fp"])

    return picked(docs, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, "id bigint, fp bigint")


def _keyed(prints: DataFrame) -> DataFrame:
    """Home rows, and probe rows (`near`), of all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                for near in (False, True):
                    rows, keys = golay_keys(part.column("fp").to_numpy(), near)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("fp").take(at), part.column("rep").take(at), pa.array([near] * len(rows))], ["key", "fp", "rep", "near"])

    return prints.mapInArrow(run, "key bigint, fp bigint, rep bigint, near boolean")


def fingerprint_links(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) that join fingerprints at most two bits apart into the right components.

    `prints`: different fingerprints fp, each with its node rep.
    """
    keyed = save(_keyed(prints), "golay-keys")
    home, probe = keyed.filter("NOT near").drop("near"), keyed.filter("near").drop("near")
    # crowded on either side: a probe key has about 16 times the rows of a home key, and few homes may meet very many of them
    sides = keyed.groupBy("key").agg(F.count_if(~F.col("near")).alias("homes"), F.count_if("near").alias("probes"))
    crowded = (F.col("homes") > bucket_limit) | ((F.col("homes") > 0) & (F.col("probes") > PROBES_A_HOME * bucket_limit))
    hot = save(sides.filter(crowded).select("key"), "hot-keys")
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    cold = home.join(hot, "key", "left_anti").alias("h").join(
        probe.join(hot, "key", "left_anti").alias("p"),
        F.expr("h.key = p.key AND h.fp < p.fp AND bit_count(h.fp ^ p.fp) <= 2"),
    )
    crowd = home.join(hot, "key", "left_semi").select("fp", "rep").unionByName(probe.join(hot, "key", "left_semi").select("fp", "rep")).distinct()
    near = crowd.select("rep", F.explode(F.expr("transform(sequence(0, 64), i -> IF(i = 64, fp, fp ^ shiftleft(1L, i)))")).alias("word"))
    least = near.groupBy("word").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1").select("word", "b")
    star = near.join(least, "word").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    return cold.select(F.col("h.rep").alias("a"), F.col("p.rep").alias("b")).unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id): fingerprint and the smallest id reachable through links of at most two bits."""
    found = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    prints = save(found.groupBy("fp").agg(F.min("id").alias("rep")), "prints")
    reached = connected_components(fingerprint_links(prints.filter("rep IS NOT NULL")))
    known = prints.join(reached, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return found.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
