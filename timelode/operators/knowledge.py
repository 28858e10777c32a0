"""Knowledge units: batches of fused rows, prompts, cleaning and filtering of drafts, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.scalars import is_blank, java_trim, segment_chars, strip_empty_slots, strip_meta_opening, truncate, unit_metadata


def batch_by_budget(fused: DataFrame, budget: int = 16_000) -> DataFrame:
    """Fused rows with `batch` (from 0): in order, a batch is closed when the next row would exceed the budget.

    A video has at most 2 000 rows, so its rows are folded in one array; the fold itself is built in.
    """
    row = F.struct("segment_index", segment_chars("transcript_text", "ocr_text").alias("chars"))
    rows = fused.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    if budget <= 0:
        return fused.withColumn("batch", F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + x["chars"] <= budget)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        used = F.when(fits, acc["used"] + x["chars"]).otherwise(x["chars"])
        return F.struct(used.alias("used"), batch.alias("batch"), F.concat(acc["out"], F.array(F.struct(x["segment_index"].alias("segment_index"), batch.alias("batch")))).alias("out"))

    kind = fused.schema["segment_index"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("batch"), F.expr(f"cast(array() as array<struct<segment_index:{kind},batch:int>>)").alias("out"))
    placed = rows.select("video_id", F.inline(F.aggregate("rows", start, step, lambda acc: acc["out"])))
    return fused.join(placed, ["video_id", "segment_index"])


def render_batch_prompt(batched: DataFrame) -> DataFrame:
    """(video_id, batch, prompt): the user message of each batch; the index runs on across batches."""
    def line(name: str, c: str) -> Column:
        return F.when(~is_blank(c), F.concat(F.lit(f"{name}: "), java_trim(c), F.lit("\n"))).otherwise("")

    index = F.row_number().over(Window.partitionBy("video_id").orderBy("segment_index")) - 1
    # the wording of the prompt is fixed: replies refer to it
    time = F.when(F.col("start_seconds").isNotNull() & F.col("end_seconds").isNotNull(), F.format_string("time: [%.2f, %.2f]\n", "start_seconds", "end_seconds")).otherwise("")
    block = F.concat(F.lit("---\nindex: "), F.col("index").cast("string"), F.lit("\n"), time, line("transcript", "transcript_text"), line("on_screen_text", "ocr_text"))
    blocks = batched.withColumn("index", index).withColumn("block", block)
    grouped = blocks.groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(F.struct("index", "block"))).alias("b"))
    head = F.concat(F.lit("Extract knowledge units from the following "), F.size("b").cast("string"), F.lit(" segments. The 'index' field is the value to use in source_segment_indices.\n\n"))
    return grouped.select("video_id", "batch", F.concat(head, F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit("---\n")).alias("prompt"))


def filter_units(drafts: DataFrame, types: list[str] | None = None, min_salience: float = 0.2, cap: int = 300) -> DataFrame:
    """Drafts of the allowed types that say something and are salient (unknown passes), the first `cap` per video."""
    found = drafts.filter(~is_blank("content") & (F.col("salience").isNull() | (F.col("salience") >= min_salience)))
    if types:
        found = found.filter(F.col("type").isin(*types))
    if cap <= 0:
        return found
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("batch", "pos"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def clean_units(drafts: DataFrame, prompt_version: int = 3, chat_model: str = "model") -> DataFrame:
    """Unit rows of filtered drafts: cut titles, cleaned bodies, metadata."""
    body = strip_meta_opening(strip_empty_slots("content"))
    meta = unit_metadata("salience", "source_segment_indices", "entity_type", prompt_version, chat_model)
    return drafts.select("video_id", "batch", "pos", "type", truncate("title", 512).alias("title"), body.alias("content"), meta.alias("metadata"), "start_seconds", "end_seconds")


def extraction_verdict(batches: DataFrame, failed: DataFrame) -> DataFrame:
    """(video_id, n_batches, n_failed, fails): one failed batch fails the video, whose old units then stay."""
    marked = batches.select("video_id", "batch").join(failed.select("video_id", "batch", F.lit(1).alias("failed")), ["video_id", "batch"], "left")
    found = marked.groupBy("video_id").agg(F.count("*").alias("n_batches"), F.count("failed").alias("n_failed"))
    return found.withColumn("fails", F.col("n_failed") > 0)


class Terms:
    """The different terms of some rules, each a list of groups of terms, and one automaton that finds them all."""

    def __init__(self, *rules: list[list[list[str | None]]]):
        self.number: dict[str, int] = {}
        # a group with a null term is never met
        self.rules = [[[{self.number.setdefault(t, len(self.number)) for t in group} for group in groups or () if group is not None and None not in group] for groups in some] for some in rules]
        self.automaton = ahocorasick.Automaton()
        for term, n in self.number.items():
            if term:
                self.automaton.add_word(term, n)
        self.automaton.make_automaton()
        self.reach = max([1, *(len(t) - 1 for t in self.number)])  # characters that a term may have on one side of a cut
        self.always = {n for t, n in self.number.items() if not t}

    def found(self, text: str) -> set[int]:
        return {n for _, n in self.automaton.iter(text)} | self.always if len(self.automaton) else set(self.always)

    def met(self, which: int, found: set[int]) -> list[int]:
        return [n for n, groups in enumerate(self.rules[which]) if any(g <= found for g in groups)]


#: Units whose texts or ends are held as Python's objects at a time.
SCANNED = 256
_UNIT = "arm {}, rep {}, unit_id {}, procedure boolean, found array<int>, n_noise bigint, head string, tail string, short boolean"
_PIECE = "arm {}, rep {}, unit_id {}, n_units bigint, n_procedures bigint, n_noise bigint, found array<int>, head string, tail string, short boolean"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SCANNED) for batch in batches for i in range(0, batch.num_rows, SCANNED))


def _scan_units(terms: Terms) -> Callable:
    """Of each unit the terms in it, the noise rules it meets, and its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            blobs = part.column("blob").to_pylist()
            found = [terms.found(b) for b in blobs]
            columns = {c: part.column(c) for c in ("arm", "rep", "unit_id", "procedure")} | {
                "found": pa.array([sorted(f) for f in found], pa.list_(pa.int32())), "n_noise": pa.array([len(terms.met(1, f)) for f in found], pa.int64()),
                "head": pa.array([b[: terms.reach] for b in blobs], pa.string()), "tail": pa.array([b[-terms.reach :] for b in blobs], pa.string()), "short": pa.array([len(b) <= terms.reach for b in blobs], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


class _Joined:
    """Texts joined by blanks, of which only the ends are held: what stands in them, and across their cuts."""

    def __init__(self, terms: Terms):
        self.terms, self.found, self.head, self.tail, self.short = terms, set(terms.always), None, "", True

    def add(self, found: list[int], head: str, tail: str, short: bool) -> None:
        reach = self.terms.reach
        self.found.update(found)
        if self.head is None:
            self.head, self.tail, self.short = head, tail, short
            return
        across = f"{self.tail} {head}"
        self.found |= self.terms.found(across)
        if self.short:
            self.head = f"{self.head} {head}"
            self.short = short and len(self.head) <= reach
            self.head = self.head[:reach]
        self.tail = across[-reach:] if short else tail


def _scan_pieces(terms: Terms) -> Callable:
    """Of each stretch of units of a run that lies in one task: sums, the terms in it, and its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sums, text, kinds = None, None, [0, 0, 0], _Joined(terms), {}

        def piece() -> pa.RecordBatch:
            values = dict(zip(("arm", "rep", "unit_id"), (*key, first), strict=True))
            columns = {c: pa.array([v], kinds[c]) for c, v in values.items()} | {c: pa.array([n], pa.int64()) for c, n in zip(("n_units", "n_procedures", "n_noise"), sums, strict=True)}
            columns |= {"found": pa.array([sorted(text.found)], pa.list_(pa.int32())), "head": pa.array([text.head], pa.string()), "tail": pa.array([text.tail], pa.string()), "short": pa.array([text.short], pa.bool_())}
            return pa.RecordBatch.from_pydict(columns)

        for part in _parts(batches):
            kinds = {c: part.schema.field(c).type for c in ("arm", "rep", "unit_id")}
            for r in part.to_pylist():
                if key != (r["arm"], r["rep"]):
                    if key is not None:
                        yield piece()
                    key, first, sums, text = (r["arm"], r["rep"]), r["unit_id"], [0, 0, 0], _Joined(terms)
                sums = [sums[0] + 1, sums[1] + bool(r["procedure"]), sums[2] + r["n_noise"]]
                text.add(r["found"], r["head"], r["tail"], r["short"])
        if key is not None:
            yield piece()

    return run


def fact_recall(units: DataFrame, facts: DataFrame, noise: DataFrame) -> DataFrame:
    """(arm, rep, n_units, n_procedures, facts, n_facts, n_noise) of extracted units; facts and noise rules are short lists.

    A fact is found where all terms of one of its groups stand in the texts of the run, joined by blanks in the order of
    their units. One automaton finds the terms of all rules in each unit. Terms that cross from one unit into the next are
    found in the ends of units, which are all that is sorted: no task holds the texts of a run, and a run with most of
    the units is cut into as many pieces as the sort has tasks. The lists (label, any_of) are written by hand; their rows are checked.
    """
    rules = [x.select("label", F.transform("any_of", lambda g: F.transform(g, F.lower)).alias("any_of")).limit(10_001).collect() for x in (facts, noise)]
    if sum(map(len, rules)) > 10_000:
        raise ValueError("facts and noise rules are meant to be short lists")
    terms, labels = Terms(*[[r.any_of for r in x] for x in rules]), [r.label for r in rules[0]]
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    rows = units.select("arm", "rep", "unit_id", F.coalesce(F.col("type") == "PROCEDURE", F.lit(False)).alias("procedure"), text.alias("blob"))
    types = [rows.schema[c].dataType.simpleString() for c in ("arm", "rep", "unit_id")]
    order = ("arm", "rep", "unit_id", "head", "tail")
    ends = rows.mapInArrow(_scan_units(terms), _UNIT.format(*types)).repartitionByRange("arm", "rep", "unit_id").sortWithinPartitions(*order)
    pieces = ends.mapInArrow(_scan_pieces(terms), _PIECE.format(*types))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        joined = _Joined(terms)
        for r in frame.sort_values("unit_id").itertuples(index=False):
            joined.add(r.found, r.head, r.tail, r.short)
        met = sorted({labels[n] for n in terms.met(0, joined.found)} - {None})
        sums = frame[["n_units", "n_procedures", "n_noise"]].sum()
        return pd.DataFrame([[frame["arm"].iloc[0], frame["rep"].iloc[0], sums.iloc[0], sums.iloc[1], met, len(met), sums.iloc[2]]], columns=["arm", "rep", "n_units", "n_procedures", "facts", "n_facts", "n_noise"])

    # as many rows a run as the sort has tasks
    return pieces.groupBy("arm", "rep").applyInPandas(whole, f"arm {types[0]}, rep {types[1]}, n_units bigint, n_procedures bigint, facts array<string>, n_facts int, n_noise bigint")


def compare_arms(scores: DataFrame, facts: DataFrame | None = None, floor: float = 3.0) -> DataFrame:
    """Per arm mean, least and most of each score over its runs, how many of these found each fact, and where there are two arms how they differ.

    `recall` lists (fact, hits) of all labels of `facts`, found or not; without `facts` those that a run of the arm found.
    `delta` is the arm's mean of facts found less the other's, `within_floor` tells whether that is noise; both are null
    unless there are just two arms. A run without scores has failed: it is no rep, and an arm of such runs has reps 0.
    """
    aggs = {f"{n}_{c.removeprefix('n_')}": f(c) for c in ("n_units", "n_procedures", "n_facts", "n_noise") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))}
    # a row a run (fact null), and one a fact that it found: the scores are read once
    found = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("facts", F.array().cast("array<string>")))).alias("fact")
    by_fact = scores.select("arm", "n_units", "n_procedures", "n_facts", "n_noise", found).groupBy("arm", "fact").agg(F.count("n_units").alias("reps"), *[x.alias(n) for n, x in aggs.items()])
    hits = F.map_from_entries(F.collect_list(F.when(F.col("fact").isNotNull(), F.struct("fact", "reps"))))
    arms = by_fact.groupBy("arm").agg(F.max(F.when(F.col("fact").isNull(), F.struct("reps", *aggs))).alias("all"), hits.alias("hits"))
    if facts is None:
        arms = arms.withColumn("labels", F.array_sort(F.map_keys("hits")))
    else:
        arms = arms.crossJoin(F.broadcast(facts.agg(F.array_sort(F.collect_set("label")).alias("labels"))))
    recall = F.transform("labels", lambda x: F.struct(x.alias("fact"), F.coalesce(F.element_at("hits", x), F.lit(0)).alias("hits")))
    every = Window.orderBy("arm").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row an arm
    mean = F.col("all.mean_facts")
    other = F.when(F.first("arm").over(every).eqNullSafe(F.col("arm")), F.last(mean).over(every)).otherwise(F.first(mean).over(every))
    delta = F.when(F.count(F.lit(1)).over(every) == 2, mean - other)
    return arms.select("arm", "all.*", recall.alias("recall"), delta.alias("delta")).withColumn("within_floor", F.abs("delta") < floor)


def fact_hits(scores: DataFrame) -> DataFrame:
    """(arm, fact, hits): how many runs of an arm found each fact."""
    return scores.select("arm", F.explode("facts").alias("fact")).groupBy("arm", "fact").agg(F.count("*").alias("hits"))


def arm_delta(arms: DataFrame, one: str, other: str, floor: float = 3.0) -> DataFrame:
    """Difference of mean facts found between two arms, and whether it lies within the noise floor; no row where an arm is missing."""
    a, b = (F.max(F.when(F.col("arm") == x, F.col("mean_facts"))).alias(n) for x, n in ((one, "a"), (other, "b")))
    both = arms.filter(F.col("arm").isin(one, other)).agg(a, b).filter("a IS NOT NULL AND b IS NOT NULL")
    return both.select((F.col("a") - F.col("b")).alias("delta"), (F.abs(F.col("a") - F.col("b")) < floor).alias("within_floor"))
