"""Writers: replace by video, upsert, append, cascade, merges into buckets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_for_videos(old: DataFrame, new: DataFrame, processed_ids: DataFrame) -> DataFrame:
    """The new rows of the processed videos and the old rows of all others; a processed video without new rows ends empty."""
    return old.join(processed_ids.select("video_id").distinct(), "video_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def write_replaced(new: DataFrame, old: DataFrame, processed_ids: DataFrame, path: str, buckets: int = 64) -> None:
    """On disk: rows lie in hash buckets of the video id, and only buckets of processed videos are written anew.

    A dynamic overwrite leaves folders alone that get no row, so those of buckets that end empty are removed after it.
    """
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets))
    touched = processed_ids.select(bucket.alias("bucket")).distinct()
    rows = replace_for_videos(old, new, processed_ids).withColumn("bucket", bucket).join(touched, "bucket", "left_semi")
    emptied = [r.bucket for r in touched.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect()]  # at most `buckets` numbers
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    session = new.sparkSession
    for number in emptied:
        folder = session._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={number}")
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def upsert_videos(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Videos by (source, source_video_id): known ones take the incoming fields and keep their id, new ones come in; all incoming are DOWNLOADED."""
    key = ["source", "source_video_id"]
    fields = [c for c in existing.columns if c not in (*key, "video_id", "status", "created_at")]
    latest = incoming.groupBy(*key).agg(F.max_by(F.struct("video_id", *fields), "video_id").alias("new"))
    both = existing.withColumn("known", F.lit(True)).join(latest, key, "full")
    came = F.col("new").isNotNull()
    merged: dict[str, Column] = {c: F.when(came, F.col(f"new.{c}")).otherwise(F.col(c)) for c in fields}
    merged |= {"video_id": F.coalesce("video_id", "new.video_id"), "status": F.when(came, "DOWNLOADED").otherwise(F.col("status")), "created_at": F.when(F.col("known"), F.col("created_at")).otherwise(now)}
    return both.select(*[merged.get(c, F.col(c)).alias(c) for c in existing.columns])


def transition_events(items: DataFrame, event_type: str, now: Column) -> DataFrame:
    """One event per item as it stands; an ended item's event carries the phase it ended in."""
    phase = F.when(F.lit(event_type).isin("ITEM_FAILED", "ITEM_CANCELLED"), F.coalesce("failed_phase", "phase")).otherwise(F.col("phase"))
    return items.select("item_id", "run_id", F.lit(event_type).alias("event_type"), F.greatest(F.coalesce("attempt", F.lit(1)), F.lit(1)).alias("attempt"), phase.alias("phase"), "status", "error_code", now.alias("occurred_at"))


def append_events(new: DataFrame, path: str) -> None:
    """Appends to the event log, partitioned by day."""
    new.withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(path)


#: So many videos' files are read at once.
READ_ROWS = 100

#: The artifacts of a video: the folder of their kind and their file name.
ARTIFACTS = {"json": "transcript.json", "text": "transcript.txt"}


def _artifact(kind: str, video_id) -> str:
    return f"{kind}/video_id={'__HIVE_DEFAULT_PARTITION__' if video_id is None else quote(str(video_id), safe='')}"


def write_transcript_artifacts(transcriptions: DataFrame, segments: DataFrame, path: str) -> None:
    """Per video a pretty JSON document and the plain text of its transcript, in folders named by the video; a null text is empty.

    The text keeps its line breaks, and either file ends with one. What `path` held of them is replaced. The files are
    written by the tasks through pyarrow's filesystems, each under an attempt's own name that is then changed to its own:
    Spark's writers take several processes a file on a local disk. Transcripts are one row a video.
    """
    session = transcriptions.sparkSession
    for kind in ARTIFACTS:
        folder = session._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)
    parts = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_seconds", "end_seconds", "text"))).alias("segments"))
    rows = transcriptions.select("video_id", "language", F.coalesce("full_text", F.lit("")).alias("text")).join(parts, "video_id", "left")
    document = F.to_json(F.struct("video_id", "language", "text", "segments"), {"pretty": "true"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for video, *values in zip(*batch.columns):
                for (kind, name), value in zip(ARTIFACTS.items(), values):
                    folder = f"{root}/{_artifact(kind, video.as_py())}"
                    where.create_dir(folder)
                    draft = f"{folder}/.{uuid.uuid4().hex}"
                    with where.open_output_stream(draft) as out:
                        out.write(f"{value.as_py()}\n".encode())
                    where.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    rows.select("video_id", document.alias("json"), "text").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def read_transcript_artifacts(videos: DataFrame, path: str) -> DataFrame:
    """(video_id, json, text): the files of the given videos as they stand below `path`; a missing one is an error.

    Files are opened by their names, without listing the folders of all videos.
    """
    kind = videos.schema["video_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)

        def text(name: str) -> str:
            with where.open_input_file(name) as file:
                return file.read().decode()

        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                ids = batch.column(0).slice(at, READ_ROWS)
                found = [[text(f"{root}/{_artifact(k, v.as_py())}/{name}") for v in ids] for k, name in ARTIFACTS.items()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.string()) for x in found)], names=["video_id", *ARTIFACTS])

    return videos.select("video_id").mapInArrow(run, f"video_id {kind.simpleString()}, json string, text string")


#: What hangs on what: table, its column, and whether a row goes or only forgets its parent.
DEPENDANTS = {
    "videos": (("speakers", "video_id", True), ("transcriptions", "video_id", True), ("transcription_segments", "video_id", True), ("video_frames", "video_id", True), ("multimodal_segments", "video_id", True), ("knowledge_units", "video_id", True), ("context_chunks", "video_id", True), ("pipeline_run_items", "video_id", False), ("pipeline_run_item_events", "video_id", False)),
    "pipeline_runs": (("pipeline_run_items", "run_id", True), ("pipeline_run_item_events", "run_id", True), ("videos", "run_id", False)),
    "youtube_channels": (("youtube_channel_videos", "channel_id", True),),
    "video_frames": (("ocr_results", "frame_id", True),),
}
KEYS = {"videos": "video_id", "pipeline_runs": "run_id", "youtube_channels": "channel_id", "video_frames": "frame_id"}


def cascade_delete(tables: dict[str, DataFrame], kind: str, ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of `kind` with the given ids and what hangs on them; tables not given are skipped."""
    key, out = KEYS[kind], dict(tables)
    gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    if kind in out:
        out[kind] = out[kind].join(gone, key, "left_anti")
    for name, column, drops in DEPENDANTS[kind]:
        if name not in out or column not in out[name].columns:
            continue
        hit = gone.withColumnRenamed(key, column)
        if not drops:
            marked = out[name].join(hit.withColumn("_gone", F.lit(True)), column, "left")
            out[name] = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in out[name].columns])
        elif name in DEPENDANTS:
            out = cascade_delete(out, name, out[name].join(hit, column, "left_semi").select(KEYS[name]))
        else:
            out[name] = out[name].join(hit, column, "left_anti")
    return out


class BucketedTable:
    """A Parquet table in hash buckets of its key, into which batches are merged: only buckets with a key of the batch are read and written.

    A merge writes the new buckets beside the old ones and then, by one rename, a manifest that names each bucket's
    folder and the batch. A reader sees the last manifest, so a merge that breaks off changes nothing, and a batch
    that the manifest already holds (batch numbers ascend) is not merged again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: jvm.Path(f"{self.path}/{name}")
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The number of merges, the last batch and the folder of each bucket that has rows."""
        folder = self._at("manifests")
        names = [int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit()] if self._files.exists(folder) else []
        if not names:
            return {"merges": 0, "batch": None, "folders": {}}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{max(names)}").first().value)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(list(self.manifest()["folders"].values()))

    def merge(self, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> list[int]:
        """The buckets written. merged(old, new) gets the rows of the touched buckets and the changes, and keeps to keys of either."""
        now = self.manifest()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return []
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = [r.bucket for r in changes.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets` numbers
        old = self._read([now["folders"][str(b)] for b in touched if str(b) in now["folders"]])
        data = f"data/{now['merges'] + 1}-{uuid.uuid4().hex[:8]}"
        rows = merged(old, changes)
        if touched:
            rows.withColumn("_bucket", bucket).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
        written = {f.getPath().getName().removeprefix("_bucket="): f"{data}/{f.getPath().getName()}" for f in self._files.listStatus(self._at(data)) if f.isDirectory()} if touched else {}
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | written
        self._commit(now["merges"] + 1, {"merges": now["merges"] + 1, "batch": now["batch"] if batch is None else batch, "folders": folders})
        return sorted(touched)

    def _commit(self, number: int, manifest: dict) -> None:
        draft = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._files.rename(draft, self._at(f"manifests/{number}")):
            raise RuntimeError(f"{self.path} has been changed by another writer")

    def vacuum(self) -> int:
        """Removes what the last manifest doesn't name; to be run while nobody reads. How many folders went."""
        now, gone = self.manifest(), 0
        kept = set(now["folders"].values())
        for data in self._files.listStatus(self._at("data")) if self._files.exists(self._at("data")) else []:
            for f in self._files.listStatus(data.getPath()):
                if f.isDirectory() and f"data/{data.getPath().getName()}/{f.getPath().getName()}" not in kept:
                    gone += bool(self._files.delete(f.getPath(), True))
        for f in self._files.listStatus(self._at("manifests")):
            if f.getPath().getName() != str(now["merges"]):
                self._files.delete(f.getPath(), False)
        return gone
