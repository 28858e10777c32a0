"""Exact deduplication with a log-structured merge index over digests.

1. Log: one scan writes (id, key, sha256) of every text, A-Z lower-cased; the key is the first eight
   bytes of the SHA-256.
2. Memtables: each task folds its share of the log into a bounded table key -> (best id, copies) and
   flushes it as sorted runs.
3. Compaction: runs are merged per key; the smallest identifier under the chosen order stays. The keys of
   several copies, the hits, make runs of their own, each of at most RUN_KEYS keys by a range of key hashes
   and with a Bloom filter of its keys, sized for them.
4. Hits ship their bytes once, to be compared with the bytes of the copy that stays. The filters of the hit
   runs decide which texts the scan ships, as long as the filters of all runs fit a worker (FILTERED_RUNS).
   Beyond that, where a good part of the texts are copies, all texts are shipped and the join with the hit runs
   alone decides; either way texts are read once for the log and once for their bytes. Texts that share a key
   without being equal are grouped by their bytes instead.

Work is one narrow shuffle of keys plus the bytes of repeated texts (or of all, beyond FILTERED_RUNS); no group is gathered in one task.
Null counts as the empty text, so nulls and empty texts are copies of one another. Rows with a null id
take part; they stay only where a group has no other id. Rows that share a group's chosen id all stay, as
nothing tells them apart. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import picked, save

MEMTABLE_ROWS = 100_000
#: Keys of a hit run, bits of its filter (16 a key), and runs whose filters a worker holds: 2 MB each, 32 MB in all.
RUN_KEYS, FILTER_BITS, FILTER_PROBES, FILTERED_RUNS = 1 << 20, 1 << 24, 6, 16
WORDS = FILTER_BITS // 64


def _digests(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
    texts = [(t.as_py() or b"").lower() for t in batch.column("text")]
    return texts, [hashlib.sha256(t).digest() for t in texts]


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=">i8").astype(np.int64)


def _log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, digests = _digests(batch)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_keys(digests)), pa.array([d.hex() for d in digests])], ["id", "key", "sha256"])


def _flush(table: dict[int, list]) -> pa.RecordBatch:
    keys = sorted(table)
    best, copies = [table[k][0] for k in keys], [table[k][1] for k in keys]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(best, pa.int64()), pa.array(copies, pa.int64())], ["key", "best", "copies"])


def _memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[int, list] = {}
    for batch in batches:
        for key, best, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "best", "copies")), strict=True):
            if (held := table.get(key)) is None:
                table[key] = [best, copies]
            else:
                held[1] += copies
                if best is not None and (held[0] is None or best < held[0]):
                    held[0] = best
            if len(table) >= MEMTABLE_ROWS:
                yield _flush(table)
                table = {}
    if table:
        yield _flush(table)


def flush_runs(log: DataFrame) -> DataFrame:
    """Sorted runs (key, best, copies) of a log of (key, best); `best` is the identifier to keep the smallest of."""
    return save(log.select("key", "best", F.lit(1).cast("long").alias("copies")).mapInArrow(_memtables, "key bigint, best bigint, copies bigint"), "runs")


def compact(*runs: DataFrame) -> DataFrame:
    """Runs of one or several flushes merged into one run per key range: the smallest identifier stays, copies add up."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return save(merged.groupBy("key").agg(F.min("best").alias("best"), F.sum("copies").alias("copies")).sortWithinPartitions("key"), "compacted")


def _positions(keys: np.ndarray) -> np.ndarray:
    """FILTER_PROBES bit positions per key, by double hashing of the digest's bits."""
    u = keys.astype(np.uint64)
    low, high = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(FILTER_PROBES, dtype=np.uint64) * high[:, None]) % np.uint64(FILTER_BITS)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters: dict[int, np.ndarray] = {}
    for batch in batches:
        keys, runs = batch.column("key").to_numpy(), batch.column("run").to_numpy()
        for run in np.unique(runs).tolist():
            filters.setdefault(run, np.zeros(FILTER_BITS, dtype=bool))[_positions(keys[runs == run]).ravel()] = True
    for run, bits in filters.items():
        words = np.packbits(bits, bitorder="little").view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array([run] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(words[used])], ["run", "word", "bits"])


def run_filters(hits: DataFrame, runs: range) -> dict[int, np.ndarray]:
    """The Bloom filters of some hit runs, packed; at most WORDS rows a run reach the driver."""
    own = hits.filter(F.col("run").between(runs[0], runs[-1])).select("key", "run").repartitionByRange(len(runs), "run")
    filters = {run: np.zeros(WORDS, dtype=np.int64) for run in runs}
    merged = own.mapInArrow(_bits, "run int, word int, bits bigint").groupBy("run", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    at, words, bits = (merged[c].to_numpy() for c in ("run", "word", "bits"))
    for run in runs:
        filters[run][words[at == run]] = bits[at == run]
    return {run: words.view(np.uint8) for run, words in filters.items()}


def _run_of(keys: np.ndarray, runs: int) -> np.ndarray:
    """The hit run of each key, as `pmod(shiftright(key, 20), runs)` in SQL; keys are bits of a digest."""
    return (keys >> 20) % runs


def might_hold(filters: dict[int, np.ndarray], keys: np.ndarray, runs: int) -> np.ndarray:
    """Whether each key's run, if its filter is given, may hold the key."""
    at, out = _run_of(keys, runs), np.zeros(len(keys), dtype=bool)
    for run, packed in filters.items():
        mine = np.flatnonzero(at == run)
        place = _positions(keys[mine])
        out[mine] = ((packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha256 of the lower-cased text.

    Of equal texts the row with the `largest` (or `smallest`) id stays. `id_col` holds integers.
    """
    spark, sign = docs.sparkSession, {"largest": -1, "smallest": 1}[keep]
    source = picked(docs, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("binary"))
    log = save(source.mapInArrow(_log, "id bigint, key bigint, sha256 string"), "log")
    index = compact(flush_runs(log.select("key", (F.col("id") * sign).alias("best"))))

    single = index.filter("copies = 1").select("key")
    runs = max(1, -(-index.filter("copies > 1").count() // RUN_KEYS))
    hits = save(index.filter("copies > 1").select("key", (F.col("best") * sign).alias("keep_id"), F.expr(f"CAST(pmod(shiftright(key, 20), {runs}) AS INT)").alias("run")), "hit-runs")

    filters = spark.sparkContext.broadcast(run_filters(hits, range(runs)) if runs <= FILTERED_RUNS else None)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests = _digests(batch)
            keys = _keys(digests)
            rows = np.arange(len(keys)) if filters.value is None else np.flatnonzero(might_hold(filters.value, keys, runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(keys[rows]), pa.array([digests[i].hex() for i in rows], pa.string()), pa.array([texts[i] for i in rows], pa.binary())],
                ["id", "key", "sha256", "text"],
            )

    members = save(source.mapInArrow(ship, "id bigint, key bigint, sha256 string, text binary").join(hits.drop("run"), "key"), "hits")
    # written, not only aggregated, so that both sides of the joins below come straight from a shuffle that a hot key can be split in
    stay = save(members.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("key").agg(F.max("text").alias("stay_text")), "stay")
    same = F.col("text") == F.col("stay_text")
    compared = save(members.join(stay, "key").select("key", "id", "sha256", "keep_id", same.alias("same"), F.when(~same, F.col("text")).alias("text")), "compared")
    sizes = save(compared.filter("same").groupBy("key").agg(F.count("*").alias("group_size")), "sizes")
    same = compared.filter("same").join(sizes, "key").select("id", "keep_id", "group_size", "sha256")
    # texts under a key that another text already holds: grouped by their own bytes
    other = compared.filter("not same").select("id", "sha256", "text")
    groups = other.groupBy("text").agg((F.min(F.col("id") * sign) * sign).alias("keep_id"), F.count("*").alias("group_size"))
    other = other.join(groups, "text").select("id", "keep_id", "group_size", "sha256")
    alone = log.join(single, "key", "left_semi").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha256")
    return alone.unionByName(same).unionByName(other).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha256")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("sha256", "text_sha256")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
