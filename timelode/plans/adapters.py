"""The generic test tables seen as tables of the data model; each rule has a SQL twin in `oracles`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.schemas import ERROR_CODES, RUN_STATUSES, UNIT_TYPES, VIDEO_STATUSES, WORK_PHASES

NOW = "2024-01-31 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _moment(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


class Tables:
    """Data-model tables over the test tables in `root`, built when asked for."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def segments(self) -> DataFrame:
        start = (F.col("turn") * 12).cast("float")
        return self.raw("conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("segment_id"), start.alias("start_seconds"), (start + 12).cast("float").alias("end_seconds"), "text", F.col("role").alias("speaker_id"))

    def turns(self) -> DataFrame:
        start = (F.col("turn") * 12 + 3).cast("float")
        return self.raw("conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seq"), start.alias("start_seconds"), (start + 12).cast("float").alias("end_seconds"), F.col("role").alias("label"))

    def speakers(self) -> DataFrame:
        rows = self.raw("conversations").select(F.col("conv_id").alias("video_id"), F.col("role").alias("speaker_id")).distinct()
        return rows.select("video_id", "speaker_id", F.concat(F.lit("SPEAKER_"), "speaker_id").alias("label"), F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("array<float>").alias("voiceprint"))

    def videos(self) -> DataFrame:
        i = F.col("doc_id")
        return self.raw("documents").select(
            i.alias("video_id"), F.col("lang").alias("source"), i.cast("string").alias("source_video_id"), F.col("source").alias("channel_name"), F.substring("text", 1, 40).alias("title"),
            _pick(VIDEO_STATUSES, i).alias("status"), F.lit(None).cast("double").alias("duration_seconds"), _moment(F.lit(1_700_000_000) + i * 7919 % 1_000_003).alias("created_at"), F.format_string("/files/%d.mp4", i).alias("file_path"),
        )

    def _lines(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "source", "n_chars", F.posexplode(F.split("text", "\n")).alias("i", "line"))

    def frames(self) -> DataFrame:
        return self._lines().select(F.col("doc_id").alias("video_id"), (F.col("doc_id") * 100_000 + F.col("i")).alias("frame_id"), F.col("i").alias("frame_index"), (F.col("i") * 10.0).alias("timestamp_seconds"))

    def ocr(self) -> DataFrame:
        own = F.struct(F.lit(0).alias("line_no"), F.col("line").alias("text"), (F.length("line") % 10 / 10.0).alias("confidence"))
        digits = F.struct(F.lit(1).alias("line_no"), F.col("n_chars").cast("string").alias("text"), F.lit(0.9).alias("confidence"))
        mark = F.struct(F.lit(2).alias("line_no"), F.col("source").alias("text"), F.lit(0.9).alias("confidence"))
        shown = F.when(F.col("doc_id") % 3 == 0, F.array(own, digits, mark)).otherwise(F.array(own, digits))
        return self._lines().select((F.col("doc_id") * 100_000 + F.col("i")).alias("frame_id"), F.inline(shown))

    def transcriptions(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("video_id"), F.col("lang").alias("language"), F.col("text").alias("full_text"))

    def units(self) -> DataFrame:
        i = F.col("vec_id")
        return self.raw("embeddings").select(
            i.alias("unit_id"), F.col("label").cast("long").alias("video_id"), _pick(UNIT_TYPES, F.col("label")).alias("type"), F.concat(F.lit("unit "), i).alias("title"), F.concat(F.lit("body of "), i).alias("content"),
            F.concat(F.lit('{"prompt_version": '), 1 + (F.col("label") + i % 2) % 3, F.lit("}")).alias("metadata"), F.when(i % 4 > 0, (i % 100).cast("double")).alias("start_seconds"), F.when(i % 4 > 0, (i % 100 + 5).cast("double")).alias("end_seconds"),
            "embedding", _moment(F.lit(1_700_000_000) + i).alias("created_at"),
        )

    def chunks(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("chunk_index"), F.concat(F.lit("chunk "), "vec_id").alias("content"), "embedding")

    def query_vector(self) -> list[float]:
        return self.raw("embeddings").orderBy("vec_id").select("embedding").first()[0]

    def events(self) -> DataFrame:
        kinds = {"signup": "ITEM_CREATED", "view": "ITEM_PHASE_ENTERED", "click": "ITEM_PHASE_COMPLETED", "error": "ITEM_FAILED", "purchase": "ITEM_COMPLETED"}
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
        k = F.get_json_object("props", "$.k").cast("int")
        failed = F.col("event_type") == "error"
        return self.raw("events").select(
            "event_id", F.col("user_id").alias("item_id"), (F.col("user_id") % 20).alias("run_id"), kind.alias("event_type"), _pick(WORK_PHASES, k).alias("phase"), F.when(failed, "FAILED").alias("status"),
            F.when(failed, _pick(ERROR_CODES, k)).alias("error_code"), (1 + F.floor(F.dayofmonth("ts") / 10)).cast("int").alias("attempt"), F.col("ts").alias("occurred_at"),
        )

    def lane_items(self) -> DataFrame:
        i = F.col("user_id")
        status = _pick(RUN_STATUSES, i)
        ended = status.isin("FAILED", "CANCELLED")
        return self.raw("events").select("user_id").distinct().select(
            i.alias("item_id"), (i % 20).alias("run_id"), status.alias("status"), _pick(WORK_PHASES, i).alias("phase"), F.when(ended & (i % 7 == 0), "CREATED").when(ended, _pick(WORK_PHASES, i)).alias("failed_phase"),
            (1 + i % 4).cast("int").alias("attempt"), (now() - F.expr("make_dt_interval(0, cast(user_id % 48 as int), 0, 0)")).alias("phase_updated_at"),
            F.when(i % 3 == 0, F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")).alias("lease_expires_at"), i.alias("video_id"), F.when(status == "FAILED", _pick(ERROR_CODES, i)).alias("error_code"), F.lit(None).cast("string").alias("error"), now().alias("created_at"),
        )

    def runs(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "IN_PROGRESS").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("FAILED")
        none = F.lit(None).cast("string")
        return self.raw("orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.lit("METADATA").alias("phase"), none.alias("error_code"), none.alias("error"), F.concat(F.lit("https://v/"), "o_orderkey").alias("video_url"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))

    def items(self) -> DataFrame:
        flag, line = F.col("l_returnflag"), F.col("l_linestatus")
        status = F.when(flag == "A", "COMPLETED").when(flag == "R", "FAILED").when(line == "F", "CANCELLED").otherwise("PENDING")
        ended = flag.isin("R") | ((flag == "N") & (line == "F"))
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"), F.col("l_orderkey").alias("run_id"), F.concat(F.lit("https://v/"), "l_partkey").alias("url"), status.alias("status"), F.lit("METADATA").alias("phase"),
            F.when(ended & (F.col("l_linenumber") != 1), _pick(ERROR_CODES, F.col("l_partkey"))).alias("error_code"), F.when(ended, F.concat(F.lit("error "), "l_suppkey")).alias("error"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("attempt"),
            F.col("l_partkey").alias("video_id"), F.when(F.col("l_suppkey") % 2 == 0, F.lit("1997-01-01").cast("timestamp_ntz")).alias("lease_expires_at"), F.col("l_shipdate").alias("created_at"),
        )

    def part_videos(self) -> DataFrame:
        i = F.col("p_partkey")
        return self.raw("part").filter(i % 2 == 0).select(i.alias("video_id"), F.when(i % 6 == 0, "vimeo").otherwise("youtube").alias("source"), i.cast("string").alias("source_video_id"), F.col("p_brand").alias("channel_name"), F.col("p_name").alias("title"), _pick(VIDEO_STATUSES, i).alias("status"), F.when(i % 10 > 0, _moment(F.lit(1_700_000_000) + i % 5)).alias("created_at"))

    def channels(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("channel_id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("display_name"), _moment(F.lit(1_700_000_000) + F.col("s_suppkey") % 7).alias("created_at"))

    def catalog(self) -> DataFrame:
        seen = F.lit("1999-01-01").cast("timestamp_ntz")
        rows = self.raw("lineitem").groupBy(F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").cast("string").alias("youtube_video_id")).agg(F.min("l_shipdate").alias("published_at"))
        return rows.select("channel_id", "youtube_video_id", F.concat(F.lit("video "), "youtube_video_id").alias("title"), F.when(F.col("youtube_video_id").cast("int") % 5 > 0, F.col("published_at")).alias("published_at"), F.concat(F.lit("https://w/"), "youtube_video_id").alias("watch_url"), F.lit("{}").alias("metadata"), seen.alias("first_seen_at"), seen.alias("last_seen_at"))

    def candidates(self) -> DataFrame:
        key = F.col("l_partkey") + F.when(F.col("l_linenumber") == 1, 1_000_000).otherwise(0)
        listed = self.raw("lineitem")
        video = F.when(F.col("l_partkey") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), key.cast("string")))
        return listed.select(F.col("l_suppkey").alias("channel_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"), video.alias("youtube_video_id"), F.concat(F.lit("new "), key.cast("string")).alias("title"), F.col("l_shipdate").alias("published_at"), F.concat(F.lit("https://n/"), key.cast("string")).alias("watch_url"), F.lit('{"n": 1}').alias("metadata"))

    def requests(self) -> DataFrame:
        p = self.raw("pages")
        url = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.concat(F.lit(" "), "url"))
        first = p.select((F.col("page_id") % 10).alias("req_id"), F.col("page_id").alias("pos"), url.alias("url"))
        return first.unionByName(first.filter("pos % 4 = 0").withColumn("pos", F.col("pos") + 1_000_000_000))

    def scored_units(self) -> DataFrame:
        rows = self.raw("documents").join(self.raw("labels"), "doc_id")
        kind = F.when(F.col("doc_id") % 3 == 0, "PROCEDURE").otherwise("CLAIM")
        return rows.select(F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("arm"), (F.col("doc_id") % 5).alias("rep"), F.col("doc_id").alias("unit_id"), kind.alias("type"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"))

    def facts(self) -> DataFrame:
        words = F.split("text", " ")
        return self.raw("benchmark").select(F.concat(F.lit("fact "), "item_id").alias("label"), F.array(F.array(words[0], words[1], words[2]), F.array(words[3], words[4])).alias("any_of"))

    def noise(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("filler").alias("label"), F.array(F.array(F.lit("all rights reserved")), F.array(F.lit("lorem"))).alias("any_of"))
