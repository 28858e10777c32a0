"""Search chunks, embeddings and exact vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.scalars import chunk_text, format_fused, snippet


def build_chunks(fused: DataFrame, transcriptions: DataFrame, max_chunks: int = 2000, whole: int = 1050) -> tuple[DataFrame, DataFrame]:
    """(chunks, refused): (video_id, chunk_index, content), and the videos with more chunks than allowed.

    A fused row of at most `whole` characters is one chunk; videos without fused text fall back to the transcript.
    """
    text = fused.select("video_id", "segment_index", format_fused("transcript_text", "ocr_text").alias("text"), F.lit(False).alias("fallback")).filter("text <> ''")
    kind = fused.schema["segment_index"].dataType.simpleString()
    spoken = transcriptions.select("video_id", F.lit(0).cast(kind).alias("segment_index"), F.col("full_text").alias("text"), F.lit(True).alias("fallback"))
    # one pass over the fused rows: each video's rows meet once, and either its fused rows or its transcript stay
    by = Window.partitionBy("video_id")
    kept = text.unionByName(spoken).withColumn("fused", F.bool_or(~F.col("fallback")).over(by)).filter("fused <> fallback")
    cut = F.col("fallback") | (F.length("text") > whole)
    pieces = F.when(cut, chunk_text(F.when(cut, F.col("text")))).otherwise(F.array("text"))
    rows = kept.select("video_id", "segment_index", F.posexplode(pieces).alias("pos", "content"))
    index = F.row_number().over(by.orderBy("segment_index", "pos")) - 1
    rows = rows.select("video_id", index.alias("chunk_index"), "content", F.count("*").over(by).alias("n"))
    refused = rows.filter(F.col("n") > max_chunks).select("video_id", "n").distinct()
    return rows.filter(F.col("n") <= max_chunks).drop("n"), refused


def distance(vector: Column | str, query: list[float], metric: str = "l2") -> Column:
    """Distance to a constant vector in double precision; null where the vector is null or of another length."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*[F.lit(float(x)) for x in query])

    def total(f: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(F.zip_with(vector, q, lambda x, y: f(x.cast("double"), y)), F.lit(0.0), lambda acc, x: acc + x)

    if metric == "cosine":
        norm = F.sqrt(total(lambda x, y: x * x)) * float(np.linalg.norm(query))
        found = 1 - total(lambda x, y: x * y) / F.nullif(norm, F.lit(0.0))
    else:
        found = F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(vector) == len(query), found)


def search_chunks(chunks: DataFrame, videos: DataFrame, query_vec: list[float], limit: int = 5, metric: str = "l2") -> DataFrame:
    """The nearest chunks with their video; chunks without a vector come last. One top-k per task, then one merge."""
    limit = max(1, min(limit, 50))
    near = chunks.withColumn("distance", distance("embedding", query_vec, metric)).orderBy(F.asc_nulls_last("distance"), "video_id", "chunk_index").limit(limit)
    near = near.select("video_id", "chunk_index", snippet("content").alias("snippet"), "distance")
    # at most 50 rows are broadcast
    return videos.select("video_id", "title", "channel_name", "file_path").join(F.broadcast(near), "video_id", "right").orderBy(F.asc_nulls_last("distance"), "video_id", "chunk_index")


def search_units(units: DataFrame, videos: DataFrame, query_vec: list[float] | None, type: str | None = None, limit: int | None = None, metric: str = "l2") -> DataFrame:
    """The nearest units that have a vector, optionally of one type; no query, no rows."""
    limit = max(1, min(10 if limit is None else limit, 50))
    found = units.filter("embedding IS NOT NULL") if query_vec else units.limit(0)
    if type is not None:
        found = found.filter(F.col("type") == type)
    near = found.withColumn("distance", distance("embedding", query_vec or [0.0], metric)).orderBy(F.asc_nulls_last("distance"), "unit_id").limit(limit)
    near = near.select("unit_id", "video_id", "type", snippet("content").alias("snippet"), "start_seconds", "end_seconds", "distance")
    return videos.select("video_id", "title", "channel_name").join(F.broadcast(near), "video_id", "right").orderBy(F.asc_nulls_last("distance"), "unit_id")


#: Queries in a block, corpus vectors in a block, and bytes of queries that are broadcast at most; beyond that, blocks of both meet by a shuffle.
QUERY_BLOCK, CORPUS_BLOCK, MOST_BROADCAST = 1024, 4096, 64 << 20


def search_batch(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", block_queries: int = QUERY_BLOCK, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(query_id, id, distance, rank): exact top-k of many queries against (id, embedding), ties by id.

    Queries and corpus are cut into blocks, which are rows with a matrix; the corpus is scanned once, whatever the
    number of queries, and each of its blocks meets each block of queries in one matrix product. A task keeps the
    best k of each query across all its blocks, so k rows a query and task are ranked. Vectors that are null or of
    another length than the queries have no distance. Query ids are different from one another.
    """
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("embedding").cast("long") * 8).alias("bytes")).first()
    blocks = max(1, -(-size.n // block_queries))
    types = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": corpus.schema["id"].dataType.simpleString()}
    dealt = asked.repartition(blocks, F.xxhash64("query_id"))
    of_queries = dealt.mapInArrow(_blocks("query_id", block_queries), f"query_ids array<{types['query_id']}>, asked binary, dims int")
    of_corpus = corpus.select("id", "embedding").mapInArrow(_blocks("id", CORPUS_BLOCK), f"ids array<{types['id']}>, vectors binary, corpus_dims int")
    # a given set of queries against all rows, block by block: no pair of rows is emitted
    met = of_corpus.join(F.broadcast(of_queries) if (size.bytes or 0) <= most_broadcast else of_queries, F.col("dims") == F.col("corpus_dims"))
    near = met.mapInArrow(_nearest(k, metric), f"query_id {types['query_id']}, id {types['id']}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(name: str, most: int) -> Callable:
    """Rows (ids, matrix, length of its rows) of up to `most` vectors; vectors of another length go to a block of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().fill_null(0).to_numpy()
            for dims in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == dims)
                for at in range(0, len(rows), most):
                    part = batch.take(pa.array(rows[at : at + most]))
                    matrix = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(name))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.tobytes()], pa.binary()), pa.array([dims], pa.int32())], ["ids", "matrix", "dims"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_ids", "asked", "dims"] if name == "query_id" else ["ids", "vectors", "corpus_dims"]
        return (b.rename_columns(names) for b in run(batches))

    return named


class _Best:
    """The k nearest so far of each query of a block, by (distance, id)."""

    def __init__(self, query_ids: pa.Array, q: np.ndarray, k: int, metric: str):
        self.query_ids, self.k, self.metric = query_ids, k, metric
        self.q = q / np.linalg.norm(q, axis=1, keepdims=True) if metric == "cosine" else q
        self.bound = np.full(len(q), np.inf)
        self.held: pa.Table | None = None

    def see(self, ids: pa.Array, x: np.ndarray) -> None:
        norms, product = (x * x).sum(axis=1), self.q @ x.T
        rough = 1 - product / np.sqrt(norms) if self.metric == "cosine" else norms - 2 * product + (self.q * self.q).sum(axis=1)[:, None]
        # one matrix product finds who may be near; their distances are then taken anew, exact for equal vectors
        slack = 1e-9 * (1 + np.abs(rough).max())
        most = min(self.k, len(x))
        bound = np.minimum(np.partition(rough, most - 1, axis=1)[:, most - 1], self.bound if self.metric == "cosine" else self.bound**2)
        row, at = np.nonzero(rough <= bound[:, None] + slack)
        d = rough[row, at] if self.metric == "cosine" else self._exact(row, at, x)
        new = pa.table({"row": pa.array(row), "distance": pa.array(d), "id": ids.take(pa.array(at))})
        both = (pa.concat_tables([self.held, new]) if self.held else new).sort_by([("row", "ascending"), ("distance", "ascending"), ("id", "ascending")])
        rows = both["row"].to_numpy()
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        self.held = both.take(pa.array(np.flatnonzero(place < self.k)))
        rows = self.held["row"].to_numpy()
        last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == self.k - 1)
        self.bound[rows[last]] = self.held["distance"].to_numpy()[last]

    def _exact(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, portion: int = 1 << 14) -> np.ndarray:
        parts = [np.sqrt(((x[at[i : i + portion]] - self.q[row[i : i + portion]]) ** 2).sum(axis=1)) for i in range(0, len(row), portion)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def rows(self) -> pa.RecordBatch:
        held = self.held.combine_chunks()
        return pa.RecordBatch.from_arrays([self.query_ids.take(held["row"].combine_chunks()), held["id"].combine_chunks(), held["distance"].combine_chunks()], ["query_id", "id", "distance"])


def _nearest(k: int, metric: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for ids, vectors, query_ids, asked, dims in zip(*(batch.column(c) for c in ("ids", "vectors", "query_ids", "asked", "dims")), strict=True):
                if not len(query_ids.values):
                    continue
                block = (query_ids.values[0].as_py(), dims.as_py())  # a query stands in one block only
                if block not in best:
                    best[block] = _Best(query_ids.values, np.frombuffer(asked.as_buffer(), np.float64).reshape(-1, dims.as_py()), k, metric)
                best[block].see(ids.values, np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, dims.as_py()))
        for found in best.values():
            yield found.rows()

    return run


def embed_texts(df: DataFrame, text_col: str, embed_fn: Callable[[list[str]], list[list[float]]], batch: int = 64, dims: int = 1536, on_error: str = "raise") -> DataFrame:
    """`df` with `embedding` from the user's model in batches of 64; null texts are embedded as empty.

    A reply of the wrong size raises, or with on_error="null" leaves the vectors of that batch null.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for at in range(0, len(frame), batch):
                texts = [t if isinstance(t, str) else "" for t in frame[text_col].iloc[at : at + batch]]
                try:
                    got = embed_fn(texts)
                    if len(got) != len(texts) or any(len(v) != dims for v in got):
                        raise ValueError("the embedding reply has the wrong size")
                except Exception:
                    if on_error == "raise":
                        raise
                    got = [None] * len(texts)
                vectors += got
            yield frame.assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, embedding array<float>")


def hash_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed feature hashing of words."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dims
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    return embed
