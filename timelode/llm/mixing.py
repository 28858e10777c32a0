"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling, in DataFrame functions only.

Each source is laid out as blocks of `block_chars` characters. A round gives source i a whole number of
turns a_i. Given weights are exact: the turns of a round are in exactly their ratio (0.999 to 0.001 makes
rounds of 1000 turns; thirds can be given as the text "1/3"), and weights that would take more than
MOST_TURNS turns are an error. Without given weights the target is size ** tempering in whole parts of
about `round_slots`, at least one. In a round of L turns
the j-th block of a source with a turns is released at turn floor((j - 1) L / a) and due before turn
ceil(j L / a). Giving the turns to the earliest deadline among the released blocks meets every window, so
after any number of turns each source is less than one block from its share, and exactly at it after each
round. One round is scheduled, once, by a fold over its turns times the sources; all rounds are alike.

When a source runs out its turns are left out, and the others keep their weights to one another; the turns
that are left are the slots of the mixed order. Rounds with the same blocks of each source form a phase; there
are at most two phases per source and one more, and only their numbers of slots are counted. The plan has one row per block
of a phase's round, and documents meet their row by a join: broadcast up to PLAN_ROWS rows, shuffled beyond.

A document's block needs its place within its source. The place is a running sum in two levels: within
about sqrt(n) hash buckets of the source's n documents, and over the buckets; no task sorts a source.
The order within a source is that of a hash of id and text.

All rows stay. A null source is a source of its own, whose weight is given under the empty name; a null text
is empty; empty texts go to the block in which they fall. Where weights are given, a source that they don't
name gets one turn a round. The list of sources, with their phases, is held in one row, so this is meant for up to some
thousand sources. Repeated rows are placed one behind the other. An empty table gives no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.llm.common import picked, save

BLOCK_CHARS, ROUND_SLOTS, TEMPERING = 16_384, 1_000, 0.5
#: Most turns of a round of given weights; turns that are scheduled at a stretch.
MOST_TURNS, STRETCH = 1_000_000, 128
#: Most rows of a plan, and phases of all sources together, that are broadcast.
PLAN_ROWS, BROADCAST_PHASES = 200_000, 1_000_000


def _turns(weights: dict[str, float | str] | None, round_slots: int) -> Column:
    """Turns of a round for each of the sources s: those given, or by size."""
    by_size = F.transform("s", lambda x: F.greatest(F.round(x["w"] / F.col("all") * round_slots), F.lit(1)).cast("int"))
    if not weights:
        return by_size
    given = F.create_map(*[F.lit(x) for pair in parts_of(weights).items() for x in pair])
    return F.transform("s", lambda x: F.coalesce(F.try_element_at(given, F.coalesce(x["source"], F.lit(""))), F.lit(1)))


RUNS = "array<struct<src:int,j:int,turn:int>>"


def earliest_deadline_first(turns: Column) -> Column:
    """Per turn of a round: the source (from 0) and which of its blocks (from 1) runs. Sources have `turns` turns a round."""
    length = F.aggregate(turns, F.lit(0), lambda acc, a: acc + a)
    none = F.expr(f"cast(array() as {RUNS})")

    def step(state: Column, t: Column) -> Column:
        def due(a: Column, i: Column) -> Column:
            j = F.element_at(state["done"], i + 1) + 1
            released = (j - 1) * state["n"] < (t + 1) * a
            return F.when((j <= a) & released, F.struct(F.ceil(j * state["n"] / a).alias("deadline"), i.alias("src"), j.alias("j")))

        def given_to(pick: Column) -> Column:
            done = F.transform(state["done"], lambda d, i: F.when(i == pick["src"], d + 1).otherwise(d))
            run = F.array(F.struct(pick["src"].alias("src"), pick["j"].cast("int").alias("j"), t.cast("int").alias("turn")))
            return F.struct(done.alias("done"), state["turns"].alias("turns"), state["n"].alias("n"), F.concat(state["plan"], run).alias("plan"))

        # through an array of one, so that the pick is found once a turn and not once for each source that looks at it
        return F.element_at(F.transform(F.array(F.array_min(F.transform(state["turns"], due))), given_to), 1)

    def stretch(state: Column, k: Column) -> Column:
        # by stretches of turns, as an array that grows turn by turn is copied each time
        some = F.sequence(k * STRETCH, F.least((k + 1) * STRETCH, state["n"]) - 1)
        begin = F.struct(state["done"].alias("done"), state["turns"].alias("turns"), state["n"].alias("n"), none.alias("plan"))
        return F.aggregate(some, begin, step, lambda s: F.struct(s["done"].alias("done"), s["turns"].alias("turns"), s["n"].alias("n"), F.concat(state["plans"], F.array(s["plan"])).alias("plans")))

    start = F.struct(F.transform(turns, lambda a: F.expr("0L")).alias("done"), F.transform(turns, lambda a: a.cast("long")).alias("turns"), length.cast("long").alias("n"), F.expr(f"cast(array() as array<{RUNS}>)").alias("plans"))
    stretches = F.sequence(F.expr("0L"), F.floor((length - 1) / STRETCH))
    return F.aggregate(stretches, start, stretch, lambda s: F.flatten(s["plans"]))


def parts_of(weights: dict[str, float | str]) -> dict[str, int]:
    """The given weights as whole turns of a round, in exactly their ratio; up to MOST_TURNS turns."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above zero")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * unit) for k, w in exact.items()}
    common = math.gcd(*whole.values())
    if sum(whole.values()) // common > MOST_TURNS:
        raise ValueError(f"the weights need a round of more than {MOST_TURNS} turns; give them as fractions or with fewer digits")
    return {k: w // common for k, w in whole.items()}


def sources_of(totals: DataFrame, block_chars: int, round_slots: int, weights: dict[str, float | str] | None, tempering: float) -> DataFrame:
    """Per source: its number src, docs, blocks, turns a round a of all length turns, and for each of its phases the first round and the one behind."""
    by_size = F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(tempering))
    share = totals.select("source", by_size.alias("w"), "docs", F.greatest(F.ceil(F.col("chars") / block_chars), F.lit(1)).cast("long").alias("blocks"))
    whole = share.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "w", "docs", "blocks"))).alias("s"), F.sum("w").alias("all"))
    whole = whole.withColumn("turns", _turns(weights, round_slots)).withColumn("length", F.aggregate("turns", F.lit(0), lambda acc, a: acc + a))
    ends = F.concat(F.array(F.expr("0L")), F.flatten(F.transform(F.arrays_zip("s", "turns"), lambda x: F.array(F.floor(x["s"]["blocks"] / x["turns"]), F.ceil(x["s"]["blocks"] / x["turns"])))))
    whole = whole.withColumn("ends", F.array_sort(F.array_distinct(ends)))
    whole = whole.withColumn("phases", F.expr("transform(slice(ends, 1, size(ends) - 1), (e, i) -> struct(int(i) AS phase, e AS first, ends[i + 1] AS next))"))
    rows = whole.select("phases", "turns", "length", F.posexplode("s").alias("src", "x")).withColumn("a", F.element_at("turns", F.col("src") + 1))
    own = F.filter("phases", lambda p: p["first"] * F.col("a") < F.col("x.blocks"))
    return rows.select("src", "x.source", "x.docs", "x.blocks", "a", "length", own.alias("phases"))


def schedule(sources: DataFrame) -> DataFrame:
    """Per source src, phase and block j (from 0) of a round: its turn in the round, its slot among those left, and the phase's slots a round and first slot start."""
    turns = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "a"))), lambda x: x["a"]).alias("turns"))
    one = save(turns.filter(F.size("turns") > 0).select(F.explode(earliest_deadline_first(F.col("turns"))).alias("run")).select("run.*"), "mix-round")
    found = one.join(sources.select("src", "a", "blocks", "phases"), "src").select("src", "j", "turn", "a", "blocks", F.explode("phases").alias("p"))
    found = found.filter(F.col("j") <= F.col("blocks") - F.col("p.first") * F.col("a"))
    found = found.select("src", "p.phase", "p.first", "p.next", (F.col("j") - 1).alias("j"), "turn")
    sizes = found.groupBy("phase", "first", "next").agg(F.count("*").alias("slots"))
    # a bounded table: two rows per source and one more
    before = F.sum((F.col("next") - F.col("first")) * F.col("slots")).over(Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("phase", "first", "slots", F.coalesce(before, F.expr("0L")).alias("start"))
    slot = F.row_number().over(Window.partitionBy("phase").orderBy("turn")) - 1
    return found.select("src", "phase", "j", "turn", slot.alias("slot")).join(sizes, "phase").select("src", "phase", "j", "turn", "slot", "first", "slots", "start")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float | str] | None = None, block_chars: int = BLOCK_CHARS, round_slots: int = ROUND_SLOTS, tempering: float = TEMPERING) -> DataFrame:
    """One row per document: _id, _source, _hash, _block (in its source), _release, _deadline, _turn, _slot and _start.

    A block's turn lies from its release to before its deadline. The mixed order is that of (_slot, _start,
    _hash): _slot is the block's place among all blocks, _start the document's first character within its source.
    """
    rows = picked(docs, id=id_col, source=F.col(f"`{source_col}`").cast("string"), n=F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("long"), hash=F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    rows = save(rows, "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("n").alias("chars"), F.count("*").alias("docs"))
    sources = save(sources_of(totals, block_chars, round_slots, weights, tempering), "mix-sources")
    plan = save(schedule(sources), "mix-plan")
    if (sources.select(F.sum(F.size("phases"))).first()[0] or 0) <= BROADCAST_PHASES:
        sources = F.broadcast(sources)
    if plan.count() <= PLAN_ROWS:
        plan = F.broadcast(plan)

    numbered = sources.select(F.col("source").alias("_source"), "src", F.ceil(F.sqrt("docs")).cast("long").alias("buckets"), "blocks", "a", "length", F.col("phases.first").alias("firsts"))
    rows = rows.join(numbered, F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", F.pmod("hash", "buckets")).drop("_source", "buckets")
    sums = rows.groupBy("src", "bucket").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("src", "bucket").orderBy("hash", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    rows = rows.join(sums, ["src", "bucket"]).withColumn("at", F.col("ahead") + F.col("before"))

    # empty texts at the very end of a source belong to its last block
    rows = rows.withColumn("block", F.least(F.floor(F.col("at") / block_chars), F.col("blocks") - 1))
    rows = rows.withColumn("round", F.floor(F.col("block") / F.col("a"))).withColumn("j", (F.col("block") - F.col("round") * F.col("a")).cast("int"))
    rows = rows.withColumn("phase", F.size(F.filter("firsts", lambda first: first <= F.col("round"))) - 1)
    rows = rows.join(plan, ["src", "phase", "j"])
    return rows.select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("hash").alias("_hash"), F.col("block").alias("_block"),
        (F.col("round") * F.col("length") + F.floor(F.col("j").cast("long") * F.col("length") / F.col("a"))).alias("_release"),
        (F.col("round") * F.col("length") + F.ceil((F.col("j").cast("long") + 1) * F.col("length") / F.col("a"))).alias("_deadline"),
        (F.col("round") * F.col("length") + F.col("turn")).alias("_turn"),
        (F.col("start") + (F.col("round") - F.col("first")) * F.col("slots") + F.col("slot")).alias("_slot"),
        F.col("at").alias("_start"),
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), *[F.col(f"_{c}").alias(c) for c in ("block", "release", "deadline", "turn", "slot", "start")])
