"""Groups of similar texts: SimHash with Golay keys proposes, a prefix filter completes, shingle sets decide.

Texts are similar if the Jaccard similarity of their word shingles reaches a bound; groups are the connected
components of that relation.

1. One scan gives each text a digest of its word sequence, its SimHash fingerprint, the size and a sketch of
   its shingle set, and the rarest of its shingles. Equal word sequences are folded to one node.
2. Candidates by SimHash: fingerprints at most two bits apart, found through their Golay keys (`simhash`).
3. Candidates by prefix: texts that share one of their rarest shingles. This loses no pair of at least the
   similarity, whatever the kind of edit. Under the first key that two texts have in common neither holds a
   shingle that comes before it in the other's order; rows that can't reach the similarity for the number of
   those go before any pair is made, and a pair that could is made under that key if under no other.
4. Under a key with few texts all pairs are asked. Under a crowded one every text is first asked against a
   pivot, the text in which the key comes first, so that a family of copies costs a few
   comparisons per member; of what is then still in different components, those outside the pivot's component
   are asked against the others, after further pivots where that would be many; there, the texts of a key on both
   sides are dealt to cells of bounded size, so that no task holds a key however crowded. Texts that share a long passage
   have many keys in common, one after the other; they are asked under the first of such a run only, where the
   bounds let the pair pass if they do under any later one.
5. Pairs whose sketches differ in too many bits go; the rest is decided on whole shingle sets, in integers. A sketch's
   bits are sums modulo two, so that sketches of long texts are as far apart as those of short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.llm.bloom import bloom, might_hold
from timelode.llm.common import picked, save
from timelode.llm.components import connected_components
from timelode.llm.simhash import SLICE, fingerprint, fingerprint_links, shingle_hashes, words_of

#: Rounds after the first pivots, the last of them without pivots; an earlier one is the last where no row of the crowded keys has more than so many others to be asked against on average.
PIVOT_ROUNDS, ASKED_PER_ROW = 3, 256
#: Pivots of a key in a later round.
PIVOTS = 1
#: Keys of a text before each of its keys that are looked at for an earlier one in common.
KEYS_BEFORE = 8
#: Texts of either side of a key that one task compares in the last round; keys with more are cut into cells of that size.
DEALT = 16_384
#: The sample that tells which shingles are common: one text in so many, but so many texts at least; the least number of them that must hold a shingle, and how many are told.
SAMPLE_SHARE, SAMPLE_TEXTS, COMMON_TEXTS, COMMON_SHINGLES = 8, 8_192, 3, 2_000_000
#: Longs of a text's sketch: one bit per hash range, which tells whether an odd number of its shingles lie there.
SKETCH_WORDS = 64
#: Rows of longs up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """df, written already, with a broadcast hint if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _dealt(side: DataFrame, other: DataFrame, of_key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by key with a column `cell`: every two rows of a key meet in one cell, of DEALT rows a side or so.

    `of_key` tells the rows of a key on either side (apart, n). A key that needs one cell has each row once.
    """
    parts = (F.ceil(F.col(c) / DEALT).cast("long").alias(name) for c, name in (("apart", "down"), ("n", "across")))
    cut = _small(save(of_key.filter(F.col("n") > DEALT).select("key", *parts), "cut-keys"))

    def dealt(df: DataFrame, own: str, others: str, cell: str) -> DataFrame:
        rows = df.join(cut, "key", "left").na.fill(1, ["down", "across"])
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit("cell")), F.col(own)))
        rows = rows.withColumn("met", F.explode(F.expr(f"sequence(0L, {others} - 1)")))
        return rows.select(*df.columns, F.expr(cell).alias("cell"))

    return dealt(side, "down", "across", "own * across + met"), dealt(other, "across", "down", "met * across + own")


def _shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text or b""), size))


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that many texts of a sample of `texts` (id, text) hold, ascending, and how many hold them.

    They only set the order in which shingles count as rare, so the sample changes the work, not the result. It grows with
    the table: a shingle that it misses is held by so many texts at most, however large the table.
    """
    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(min(SAMPLE_SHARE, -(-max(texts.count(), 1) // SAMPLE_TEXTS)))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(t.as_py(), size).view(np.int64))], ["key"])

    counts = sample.mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_TEXTS)
    found = save(counts, "common-shingles").orderBy(F.desc("n"), "key").limit(COMMON_SHINGLES).toArrow()
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], share: Fraction) -> np.ndarray:
    """The rarest of a text's ascending hashes, as many as it takes to share one with every text of at least that similarity.

    A text that is so similar holds share * n of the n hashes or more, so it can't miss n - ceil(share * n) + 1 of
    them; as both texts take theirs by one order of all hashes, one of these is the same.
    """
    counts = np.zeros(len(hashes), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        counts = np.where(common[0][at] == hashes, common[1][at], 0)
    most = len(hashes) - -(-share.numerator * len(hashes) // share.denominator) + 1
    return hashes[np.argsort(counts, kind="stable")[:most]]


def _sketch(hashes: np.ndarray) -> np.ndarray:
    n = 64 * SKETCH_WORDS
    held = np.bincount(((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64), minlength=n)
    return np.packbits((held & 1).astype(bool)).view(np.int64)


PROFILE = "id bigint, same binary, fp bigint, size int, sketch array<bigint>, keys array<bigint>"


def profiles(texts: DataFrame, size: int, share: Fraction) -> DataFrame:
    """Per row of `texts` (id, text): digest of the words, fingerprint, number of shingles, sketch, prefix."""
    told = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            same, prints, sizes, sketches, keys = [], [], [], [], []
            for t in batch.column("text"):
                words = words_of(t.as_py() or b"")
                hashes = shingle_hashes(words, size)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(fingerprint(hashes) if words else 0)
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                sketches.append(_sketch(hashes))
                keys.append(prefix(hashes, told.value, share).view(np.int64))
            longs = pa.list_(pa.int64())
            columns = [batch.column("id"), pa.array(same, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "same", "fp", "size", "sketch", "keys"])

    return texts.mapInArrow(run, PROFILE)


def _met_keys(batches: Iterator[pa.RecordBatch], told: Broadcast) -> Iterator[pa.RecordBatch]:
    """A row for each key of a text that other texts may have too, with the number of shingles from there on."""
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        keys, counts = batch.column("keys").flatten().to_numpy(), batch.column("keys").value_lengths().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), counts)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = np.flatnonzero(might_hold(told.value, keys))
        at = pa.array(row[kept])
        sizes = batch.column("size").to_numpy()[row[kept]]
        columns = [batch.column("node").take(at), batch.column("same").take(at), pa.array(sizes), pa.array((sizes - place[kept]).astype(np.int32)), pa.array(keys[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["node", "same", "size", "rest", "key"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        same = [xxhash.xxh3_128_digest(b" ".join(words_of(t.as_py() or b""))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(same, pa.binary()), batch.column("text")], ["node", "same", "text"])


def _similar_pairs(batches: Iterator[pa.RecordBatch], size: int, share: Fraction) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) with their texts, those whose shingle sets are similar enough; a set serves the next rows of its text too."""
    num, den = share.numerator, share.denominator
    held = {"a": (None, None), "b": (None, None)}
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        kept = []
        for i in range(batch.num_rows):
            for c in "ab":
                node = batch.column(c)[i].as_py()
                if held[c][0] != node:
                    held[c] = node, _shingle_set(batch.column(f"t{c}")[i].as_py(), size)
            a, b = held["a"][1], held["b"][1]
            if (num + den) * len(np.intersect1d(a, b, assume_unique=True)) >= num * (len(a) + len(b)):
                kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_limit: int = 16) -> DataFrame:
    """(id, component_id), one row per id: groups of texts linked by a Jaccard similarity of word shingles, verified in full.

    Words are cut at ASCII white space, A-Z lower-cased; a text of fewer words is one shingle; null counts as
    empty, and empty texts are equal. Rows with a null id are left out. Of rows that share an id the text with
    the least digest is compared. An empty table gives no rows.
    """
    share = Fraction(str(similarity))
    num, den = share.numerator, share.denominator
    rows = picked(docs, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("binary")).filter("id IS NOT NULL")
    found = save(profiles(rows, shingle, share), "profiles")
    one = save(found.groupBy("id").agg(F.min("same").alias("same")), "one-text")
    nodes = save(one.groupBy("same").agg(F.min("id").alias("node")), "word-nodes")
    repeated = one.count() < found.count()
    stands = found.withColumnRenamed("id", "node")
    found = stands.join(nodes, ["same", "node"], "left_semi")
    if repeated:
        found = found.dropDuplicates(["node"])
    sketches = found.select("node", "sketch", "size")

    # rows under keys that several texts have; `rest` is what a text can share with one that it first meets under the key
    met = save(found.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1").select("key"), "met-keys")
    told = bloom(met, met.count())
    under = stands.select("node", "same", "size", "keys").mapInArrow(lambda batches: _met_keys(batches, told), "node bigint, same binary, size int, rest int, key bigint")
    under = under.join(nodes, ["same", "node"], "left_semi").drop("same")
    if repeated:
        under = under.distinct()
    under = save(under, "under-some-keys")
    sizes = save(under.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("least")).filter("n > 1"), "key-sizes")
    under = under.join(_small(sizes), "key").filter((num + den) * F.col("rest") >= num * (F.col("size") + F.col("least")))
    rows_of = save(under.select("key", "n", "node", "size", "rest"), "under-keys")
    cold, crowd = rows_of.filter(F.col("n") <= bucket_limit), rows_of.filter(F.col("n") > bucket_limit).drop("n")

    # bounds that drop no link: on what both can share, and as each bit in which sketches differ needs a shingle that only one has
    fits = f"{num + den} * least(h.rest, p.rest) >= {num} * (h.size + p.size)"
    differ = " + ".join(f"bit_count(h.sketch[{i}] ^ p.sketch[{i}])" for i in range(SKETCH_WORDS))
    near = f"{num + den} * ({differ}) <= {den - num} * (h.size + p.size)"

    def pairs_of(a: str, b: str, df: DataFrame) -> DataFrame:
        return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b")

    def likely(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(sketches.alias("h"), F.col("a") == F.col("h.node"))
        return save(pairs.join(sketches.alias("p"), F.expr(f"b = p.node AND {near}")).select("a", "b"), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        # texts of candidates only; they move as they are, which takes less of disks than their shingle sets
        wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        texts = rows.join(_small(wanted), "id", "left_semi")
        if repeated:
            texts = texts.mapInArrow(_digests, "node bigint, same binary, text binary").join(nodes, ["same", "node"], "left_semi")
            texts = texts.dropDuplicates(["node"]).select(F.col("node").alias("id"), "text")
        left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        return pairs.join(left, "a").join(right, "b").mapInArrow(lambda batches: _similar_pairs(batches, shingle, share), "a bigint, b bigint")

    def pivots(placed: DataFrame, turn: int) -> DataFrame:
        """Per key whose texts are in several components: the text in which it comes first, or later on some by hash, with the component of one."""
        early = [(F.col("size") - F.col("rest")) / F.col("size")]
        orders = [F.struct(*([] if turn else early), F.xxhash64("node", F.lit(turn), F.lit(i)), "node") for i in range(PIVOTS if turn else 1)]
        some = F.array_distinct(F.array(*[F.min_by(F.struct("node", "size", "rest", "component"), x) for x in orders]))
        found = placed.groupBy("key").agg(some.alias("some"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
        return found.select("key", F.col("some")[0]["component"].alias("main"), F.explode("some").alias("p")).select("key", "main", "p.*")

    def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
        links = save(links, "links")
        return groups if links.isEmpty() else save(connected_components(links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))), "groups")

    prints = save(found.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    by_print = pairs_of("node", "rep", found.select("node", "fp").join(prints, "fp")).unionByName(pairs_of("a", "b", fingerprint_links(prints)))
    by_key = pairs_of("h.node", "p.node", cold.alias("h").join(cold.alias("p"), F.expr(f"h.key = p.key AND h.node > p.node AND {fits}")))
    first = _small(save(pivots(crowd.withColumn("component", F.col("node")), 0), "pivots"))
    by_pivot = pairs_of("h.node", "p.node", crowd.alias("h").join(first.alias("p"), F.expr(f"h.key = p.key AND {fits}")))
    pairs = likely(by_print.unionByName(by_key).unionByName(by_pivot))
    # one pair of each text first, as most others are within the groups that these make
    groups = save(connected_components(verified(pairs.groupBy("a").agg(F.min("b").alias("b")))), "groups")
    ends = [groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab"]
    rest = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    groups = joined(groups, verified(save(rest.select("a", "b"), "other-pairs")))

    for turn in range(1, PIVOT_ROUNDS + 1):
        placed = crowd.join(groups, "node", "left").select("key", "node", "size", "rest", F.coalesce("component", "node").alias("component"))
        asked = _small(save(pivots(placed, turn), "pivots"))
        if asked.isEmpty():  # every key's texts are in one component
            break
        placed = save(placed.join(asked.select("key", "main").distinct(), "key"), "placed")
        crowd, inside = placed.drop("component", "main"), F.count(F.when(F.col("component") == F.col("main"), 1))
        of_key = save(placed.groupBy("key").agg(F.count("*").alias("n"), (F.count("*") - inside).alias("apart")), "of-keys")
        work = of_key.agg(F.sum(F.col("n") * F.col("apart")).alias("asked"), F.sum("n").alias("n")).first()
        last = turn == PIVOT_ROUNDS or work["asked"] <= ASKED_PER_ROW * work["n"]
        side, other, bound = placed, asked, fits
        if last:  # sketches on both sides, so that rows come only of pairs that pass all bounds, once where their keys follow one another
            drawn = placed.withColumn("before", F.collect_list("key").over(Window.partitionBy("node").orderBy(F.desc("rest")).rowsBetween(-KEYS_BEFORE, -1)))
            drawn = save(drawn.join(sketches.drop("size"), "node"), "drawn")
            once = "(h.node > p.node OR p.component = p.main) AND NOT arrays_overlap(h.before, p.before)"
            side, other = _dealt(drawn.filter("component <> main"), drawn, of_key)
            bound = f"h.cell = p.cell AND {fits} AND {once} AND {near}"
        pairs = pairs_of("h.node", "p.node", side.alias("h").join(other.alias("p"), F.expr(f"h.key = p.key AND h.component <> p.component AND {bound}")))
        groups = joined(groups, verified(save(pairs.distinct(), "pairs") if last else likely(pairs)))
        if last:
            break
    of_node = nodes.join(groups, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    return one.join(of_node, "same").select(F.col("id").alias(id_col), "component_id")
