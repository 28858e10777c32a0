"""Raw JSON and text into typed rows, through the variant type.

The names of JSON keys, with their aliases in order, are fixed values: they are what the tools that write the files use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.functions.scalars import channel_of, date_of_digits, is_blank, java_trim, publish_date_of, source_of, source_video_id_of, utc_midnight
from timelode.schemas import TABLES, UNIT_TYPES


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of the data model below `root`, with its fixed schema."""
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in TABLES.items()}


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, json_columns: tuple[str, ...] = (), **options: str) -> DataFrame:
    """A table of a database, read by `partitions` tasks over equal ranges of a numeric or time `key`; without a key, or of an empty table, by one.

    The bounds are the least and largest key now, asked by one query; rows with a null key or beyond them are read by
    the outer ranges. Filters and columns are passed on to the database. `json_columns` come back as variants, null
    where their text is no JSON. Further options, as user, password, driver and fetchsize, are Spark's.
    """
    reader = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    more: dict = {}
    if key:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        low, high = reader(query=f"SELECT MIN({name}) AS low_key, MAX({name}) AS high_key FROM {table}").load().first()
        if low is not None:
            more = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    rows = reader(dbtable=table, **more).load()
    return rows.withColumns({c: F.try_parse_json(c) for c in json_columns})


def read_jdbc_tables(spark: SparkSession, url: str, keys: dict[str, str | None], **options: str) -> dict[str, DataFrame]:
    """Tables of the data model by their names, each with the key that its reading is cut by; their `metadata` as variants."""
    found = {}
    for name, key in keys.items():
        known = [part.split(" ")[0] for part in TABLES[name].split(", ")]
        found[name] = read_jdbc_table(spark, url, name, key, json_columns=("metadata",) if "metadata" in known else (), **options)
    return found


def _get(v: Column, kind: str, *keys: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", kind) for k in keys])


def _text(v: Column, *keys: str) -> Column:
    """The first of the keys that is not blank, trimmed."""
    return F.coalesce(*[F.when(~is_blank(t := F.try_variant_get(v, f"$.{k}", "string")), java_trim(t)) for k in keys])


def _number(v: Column, *keys: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "double") for k in keys])


def _is_number(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _list(v: Column, *keys: str) -> Column:
    return _get(v, "array<variant>", *keys)


def _parsed(raw: DataFrame, json: str = "json") -> DataFrame:
    return raw.withColumn("_v", F.try_parse_json(json))


def parse_transcripts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transcriptions, segments) of raw (video_id, json); segments lacking a time or text are dropped."""
    v = _parsed(raw).filter("_v IS NOT NULL")
    head = v.select("video_id", _text(F.col("_v"), "language").alias("language"), F.coalesce(_get(F.col("_v"), "string", "text"), F.lit("")).alias("full_text"))
    each = v.select("video_id", F.posexplode(_list(F.col("_v"), "segments")).alias("segment_id", "s"))
    s = F.col("s")
    start = F.coalesce(_number(s, "start", "start_seconds", "startSeconds"), F.try_variant_get(s, "$.timestamps[0]", "double"))
    end = F.coalesce(_number(s, "end", "end_seconds", "endSeconds"), F.try_variant_get(s, "$.timestamps[1]", "double"))
    rows = each.select("video_id", "segment_id", start.cast("float").alias("start_seconds"), end.cast("float").alias("end_seconds"), _text(s, "text", "transcript").alias("text"))
    return head, rows.dropna()


def parse_diarization(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, speakers) of raw (video_id, json); a voiceprint with any element that is no number is null."""
    v = _parsed(raw).filter("_v IS NOT NULL")
    s = F.col("s")
    turns = v.select("video_id", F.posexplode(_list(F.col("_v"), "segments", "turns")).alias("seq", "s"))
    turns = turns.select("video_id", "seq", _number(s, "start", "start_seconds", "startSeconds").cast("float").alias("start_seconds"), _number(s, "end", "end_seconds", "endSeconds").cast("float").alias("end_seconds"), _text(s, "speaker", "speaker_label", "speakerLabel", "label").alias("label")).dropna()
    speakers = v.select("video_id", F.explode(_list(F.col("_v"), "speakers")).alias("s"))
    prints = F.try_variant_get(s, "$.embedding", "array<variant>")
    good = (F.size(prints) > 0) & F.forall(prints, lambda x: F.coalesce(_is_number(x), F.lit(False)))
    speakers = speakers.select("video_id", _text(s, "label", "speaker", "id").alias("label"), F.when(good, F.transform(prints, lambda x: F.try_variant_get(x, "$", "double").cast("float"))).alias("voiceprint"))
    return turns, speakers.filter("label IS NOT NULL")


def parse_ocr(raw: DataFrame, default_lang: str) -> DataFrame:
    """Lines of raw (frame_id, json), a list or an object with `lines`; a box with a malformed point is null as a whole."""
    v = _parsed(raw)
    lines = F.coalesce(_list(F.col("_v"), "lines", "results"), F.try_variant_get("_v", "$", "array<variant>"))
    s = F.col("s")
    each = v.select("frame_id", F.posexplode(lines).alias("line_no", "s"))
    points = F.transform(F.try_variant_get(s, "$.bbox", "array<variant>"), lambda p: F.try_variant_get(p, "$", "array<variant>"))
    good = (F.size(points) > 0) & F.forall(points, lambda p: p.isNotNull() & (F.size(p) >= 2) & F.forall(p, lambda x: F.coalesce(_is_number(x), F.lit(False))))
    box = F.when(good, F.transform(points, lambda p: F.transform(p, lambda x: F.try_variant_get(x, "$", "double"))))
    rows = each.select("frame_id", "line_no", _text(s, "text", "transcription").alias("text"), _number(s, "confidence", "score").cast("float").alias("confidence"), box.alias("bbox"), F.coalesce(_text(s, "language", "lang"), F.lit(default_lang)).alias("language"))
    return rows.filter("text IS NOT NULL")


def parse_video_metadata(raw: DataFrame) -> DataFrame:
    """Video rows of downloader output (url, json, file_path); lines before the JSON are skipped."""
    body = F.regexp_extract("json", r"(?s)(?:^|\n)\s*(\{.*)$", 1)
    meta = raw.select("url", "file_path", F.when(F.try_parse_json(body).isNotNull() & (body != ""), body).alias("m")).filter("m IS NOT NULL")
    duration = F.try_variant_get(F.try_parse_json("m"), "$.duration", "variant")
    return meta.select(
        source_of("m").alias("source"), source_video_id_of("m").alias("source_video_id"), F.get_json_object("m", "$.title").alias("title"), F.get_json_object("m", "$.description").alias("description"),
        channel_of("m").alias("channel_name"), F.when(_is_number(duration), F.try_variant_get(duration, "$", "double").cast("int")).alias("duration_seconds"), publish_date_of("m").alias("published_at"), "file_path", "url",
    )


def parse_channel_listing(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channels, candidates) of raw (channel_url, json)."""
    v = _parsed(raw)
    c = F.col("_v")
    channels = v.select("channel_url", _text(c, "channel_id", "uploader_id").alias("channel_id"), _text(c, "channel", "uploader", "title").alias("display_name"))
    # what a listing says once is read before its entries are dealt out, and each field of an entry once
    once = v.select("channel_url", _text(c, "channel_id", "uploader_id").alias("channel_id"), _list(c, "entries").alias("entries"))
    each = once.select("channel_url", "channel_id", F.posexplode("entries").alias("pos", "e"))
    e = F.col("e")
    epoch = F.try_variant_get(e, "$.timestamp", "variant")
    day = F.try_variant_get(e, "$.upload_date", "string")
    video = _text(e, "id", "url")
    fields = each.select("channel_url", "channel_id", "pos", "e", video.alias("youtube_video_id"), F.try_variant_get(e, "$.title", "string").alias("title"), day.alias("day"), epoch.alias("epoch"))
    published = F.coalesce(utc_midnight(date_of_digits(F.col("day"))), F.when(_is_number(F.col("epoch")), F.timestamp_seconds(F.try_variant_get(e, "$.timestamp", "long"))))
    rows = fields.select("channel_url", "channel_id", "pos", "youtube_video_id", "title", published.alias("published_at"), F.concat(F.lit("https://www.youtube.com/watch?v="), "youtube_video_id").alias("watch_url"), F.to_json(e).alias("metadata"))
    return channels, rows.filter("youtube_video_id IS NOT NULL")


def parse_frame_log(raw: DataFrame) -> DataFrame:
    """(video_id, seq, n, pts_time, width, height) per log line (video_id, text) that tells of a frame."""
    line = F.col("line")
    shown = r"Parsed_showinfo.*?\bn:\s*(\d+)\b.*?\bpts_time:\s*([0-9]+(?:\.[0-9]+)?)"
    rows = raw.select("video_id", F.posexplode(F.split("text", "\r?\n")).alias("seq", "line")).filter(line.rlike(shown))
    size = r"\bs:(\d+)x(\d+)\b"
    return rows.select("video_id", "seq", F.regexp_extract(line, shown, 1).cast("int").alias("n"), F.regexp_extract(line, shown, 2).cast("double").alias("pts_time"), *[F.nullif(F.regexp_extract(line, size, i), F.lit("")).cast("int").alias(c) for i, c in ((1, "width"), (2, "height"))])


def parse_units(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts, failed batches) of model replies (video_id, batch, json).

    A batch fails where its JSON is bad, no list of units is found, an element is no object, or a list
    that is not empty yields no draft; an empty list is a good empty reply.
    """
    v = _parsed(replies)
    c = F.col("_v")
    named = F.coalesce(F.try_variant_get(c, "$", "array<variant>"), _list(c, "units", "knowledge_units", "knowledgeUnits", "items", "data", "results"))
    values = F.map_values(F.from_json("json", "map<string,variant>"))
    lists = F.filter(F.transform(values, lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: (F.size(x) > 0) & F.try_variant_get(x[0], "$.type", "variant").isNotNull() & F.try_variant_get(x[0], "$.content", "variant").isNotNull())
    found = v.select("video_id", "batch", F.coalesce(named, F.try_element_at(lists, F.lit(1))).alias("units"))
    each = found.select("video_id", "batch", F.posexplode("units").alias("pos", "u"))
    u = F.col("u")
    kind = F.upper(java_trim(_get(u, "string", "type")))
    indices = F.coalesce(_list(u, "source_segment_indices"), _list(u, "sourceSegmentIndices"), F.expr("cast(array() as array<variant>)"))
    numbers = F.transform(F.filter(indices, lambda x: F.coalesce(_is_number(x), F.lit(False))), lambda x: F.try_variant_get(x, "$", "double").cast("int"))
    drafts = each.select(
        "video_id", "batch", "pos", kind.alias("type"), _get(u, "string", "title").alias("title"), _text(u, "content").alias("content"), _number(u, "salience").alias("salience"), numbers.alias("source_segment_indices"),
        _number(u, "start_seconds", "startSeconds").alias("start_seconds"), _number(u, "end_seconds", "endSeconds").alias("end_seconds"), _get(u, "string", "entity_type", "entityType").alias("entity_type"),
    ).filter(F.col("type").isin(*UNIT_TYPES) & F.col("content").isNotNull())
    objects = F.forall("units", lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    counts = drafts.groupBy("video_id", "batch").agg(F.count("*").alias("n"))
    judged = found.join(counts, ["video_id", "batch"], "left")
    failed = judged.filter(F.col("units").isNull() | ~objects | ((F.size("units") > 0) & F.col("n").isNull())).select("video_id", "batch")
    return drafts.join(failed, ["video_id", "batch"], "left_anti"), failed


URL = r"^https?://[^\s/$.?#].[^\s]*$"


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file; blank lines and lines that start with # are skipped."""
    line = java_trim("value")
    return spark.read.text(path).select(line.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#") & F.col("url").rlike(URL))


def parse_url_paste(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid, invalid, duplicates) of pasted text (req_id, raw): one bad token makes its line invalid; the first copy of a URL counts."""
    lines = df.select("req_id", F.posexplode(F.split("raw", "\n")).alias("line_no", "line")).withColumn("line", java_trim("line")).filter("line <> ''")
    tokens = F.filter(F.split("line", r"[\s,]+"), lambda t: t != "")
    judged = lines.withColumn("tokens", tokens).withColumn("good", F.forall("tokens", lambda t: t.rlike(URL)))
    invalid = judged.filter("not good").select("req_id", "line_no", "line")
    each = judged.filter("good").select("req_id", "line_no", F.posexplode("tokens").alias("pos", "url"))
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("req_id", "url").orderBy("line_no", "pos")))
    duplicates = ranked.groupBy("req_id").agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicates"))
    return ranked.filter("n = 1").select("req_id", "line_no", "pos", "url"), invalid, duplicates
