"""Cross-tokenizer alignment: the groups of tokens of two tokenizers that cover the same bytes, and what is linked in them.

Both tokenizers cut the bytes of " " + text without a gap. All tokens of a slice of texts are numbered through, and
every token points to its farthest-right overlapping token of the other tokenizer, unless both end at the same byte:
then both point to the second tokenizer's token there. Doubling all pointers (p = p[p]) until nothing moves leads each
token to the last one of its group, which labels the group.

Two jobs. The first is a map over the texts; it writes what each document says of itself and its different id pairs
with their counts to the shared folder. The second counts, by a partial aggregation, how many documents hold each
pair, and brings the counts back to the pairs: pairs in HEAVY documents or more, of which the number is bounded
by the links over HEAVY, travel by a broadcast behind a check of their number, the others by a join on the pair.

Tokenizer files are read on the executors: their paths must name the same files everywhere.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import picked, save

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of the texts that are aligned together, and different pairs that are broadcast at once, at most.
SLICE_BYTES, MOST_PAIRS = 1_000_000, 500_000
#: How a byte-level tokenizer's pretokens are told; a fixed pattern of such tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters in which byte-level vocabularies are written: printable bytes as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


#: Texts with one of these characters don't go to the faster library, which might class them differently.
ODD = re.compile("[\u0180-\U0010ffff]")


@dataclass
class Side:
    """One tokenizer: " " + text into ids, and the bytes of its ids. Ids come as an array where they cannot but give the text's bytes, else as a list."""

    encode: Callable[[list[str]], list]
    pieces: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)


@lru_cache(1)
def byte_level(path: str) -> Side:
    """Byte-level BPE. Where ids are the order of merges, texts of common characters go to a faster library, which then gives the same."""
    import tiktoken
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocab, special, alphabet = told["model"]["vocab"], {t["content"] for t in told["added_tokens"]}, byte_alphabet()
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = piece.encode() if piece in special else bytes(alphabet[c] for c in piece)
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    in_order = all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges)) and not told["model"].get("ignore_merges") and told.get("normalizer") is None
    in_order = in_order and {bytes([b]) for b in range(256)} == set(pieces[:256])
    quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces) if i < 256 + len(merges)}, special_tokens={}) if in_order else None

    def encode(texts: list[str]) -> list:
        out: list = [quick.encode_to_numpy(f" {t}", disallowed_special=()) if quick and not ODD.search(t) else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, found.encode_batch([f" {texts[k]}" for k in rest], add_special_tokens=False) if rest else (), strict=True):
            out[k] = e.ids
        return out

    return Side(encode, pieces)


@lru_cache(1)
def sentence_pieces(path: str) -> Side:
    """Pieces; the tokenizer puts a blank in front itself."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(p[3:5], 16)]) if found.is_byte(i) else p.replace("\u2581", " ").encode() for i in range(found.get_piece_size()) for p in (found.id_to_piece(i),)]
    return Side(lambda texts: found.encode(texts, num_threads=1), pieces)


@dataclass
class Alignment:
    """Tokens of some texts in a row. Of each side: ids, and the group of each token; edges of texts among tokens and groups."""

    ids: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    edges: tuple[np.ndarray, np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray, np.ndarray]  # text, id of A, id of B


def labels(ends: tuple[np.ndarray, np.ndarray], below: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The last token of the group of each token, by doubled pointers; tokens of B are numbered behind those of A.

    ends: byte ends of the tokens of either side; below[k][x]: how many tokens of side k end at byte x or before.
    """
    n = len(ends[0])
    far = [below[1 - k][ends[k] - 1] for k in (0, 1)]  # the other side's token that holds the last byte
    past = [ends[1 - k][far[k]] > ends[k] for k in (0, 1)]
    point = np.concatenate([far[0] + n, np.where(past[1], far[1], np.arange(len(ends[1])) + n)])
    while True:
        further = point[point]
        if (further == point).all():
            return point[:n], point[n:]
        point = further


def align(ids: tuple[list, list], sides: tuple[Side, Side]) -> Alignment:
    """Aligns texts of at least one byte each that the ids of either side cover without a gap."""
    counts = [np.array([len(x) for x in side], np.int64) for side in ids]
    flat = tuple(np.concatenate([np.asarray(x, np.int64) for x in side]) for side in ids)
    ends = tuple(np.cumsum(s.sizes[f]) for s, f in zip(sides, flat, strict=True))
    tokens = [np.append(0, np.cumsum(c)) for c in counts]
    edge = np.append(0, ends[0])[tokens[0]]
    marks = np.zeros((2, int(edge[-1]) + 1), bool)
    for k in (0, 1):
        marks[k][ends[k]] = True
    below = tuple(np.cumsum(m, dtype=np.int64) for m in marks)
    last = labels(ends, below)
    name = np.cumsum(np.bincount(last[1] - len(ends[0]), minlength=len(ends[1])) > 0) - 1  # groups in the order of their last tokens
    group = tuple(name[x - len(ends[0])] for x in last)
    cut = np.flatnonzero(marks.any(axis=0))  # each stretch between two cuts is one link
    text = np.searchsorted(edge, cut, side="left") - 1
    links = (text, flat[0][below[0][cut - 1]], flat[1][below[1][cut - 1]])
    both = np.cumsum(marks.all(axis=0))
    return Alignment(flat, group, (*tokens, both[edge]), links)


def listed(found: Alignment, tables: tuple[np.ndarray, np.ndarray], kinds: tuple[int, int]) -> Iterator[memoryview]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    (a, b), (ga, gb) = found.ids, found.group
    place = (np.arange(len(a)) + np.searchsorted(gb, ga), np.arange(len(b)) + np.searchsorted(ga, gb, side="right"))
    code = np.empty(len(a) + len(b), np.int64)
    for k, (ids, g, base) in enumerate(((a, ga, 0), (b, gb, 2 * kinds[0]))):
        closes = np.append(g[1:] != g[:-1], True)
        code[place[k]] = ids + base + closes * kinds[k]
    letters, sizes = tables
    size = sizes[code]
    line = memoryview(letters[code][np.arange(letters.shape[1]) < size[:, None]]).cast("B")
    edge = np.append(0, np.cumsum(size))[found.edges[0] + found.edges[1]]
    return (line[x : y - 1] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


@lru_cache(1)
def _tables(kinds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids as decimals with what may follow them, ids of A and B with two ends each: letters, and how many count."""
    text = [b"%d%c" % (i, end) for n, ends in zip(kinds, (b",|", b",;"), strict=True) for end in ends for i in range(n)]
    sizes = np.array([len(t) for t in text])
    return np.array(text, f"S{sizes.max()}").view(np.uint8).reshape(len(text), -1), sizes


_SCHEMA = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string())]
_DDL = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string"


def _slice(texts: list[str | None], sides: tuple[Side, Side], with_groups: bool) -> tuple[list[pa.Array], pa.Array, pa.Array]:
    """The columns of _SCHEMA for some texts, and the different pairs of each (A id * kinds of B + B id) with their counts."""
    some = [k for k, t in enumerate(texts) if t]
    ids = [side.encode([texts[k] for k in some]) for side in sides] if some else [[], []]
    good = [all(isinstance(i, np.ndarray) or b"".join(map(s.pieces.__getitem__, i)) == f" {texts[k]}".encode() for s, i in zip(sides, pair, strict=True)) for k, *pair in zip(some, *ids, strict=True)]
    some, *ids = ([v for v, g in zip(x, good, strict=True) if g] for x in (some, *ids))
    kinds = (len(sides[0].pieces), len(sides[1].pieces))
    figures, strings, digests = np.zeros((4, len(texts)), np.int64), [""] * len(texts), [""] * len(texts)
    pair = count = np.zeros(0, np.int64)
    per_text = np.zeros(len(texts), np.int64)
    if some:
        at = np.array(some)
        found = align(tuple(ids), sides)
        for k in range(3):
            figures[k][at] = np.diff(found.edges[k])
        text, a, b = found.links
        figures[3][at] = np.bincount(text, minlength=len(at))
        key, count = np.unique((text * kinds[0] + a) * kinds[1] + b, return_counts=True)
        pair = key % (kinds[0] * kinds[1])
        per_text[at] = np.bincount(key // (kinds[0] * kinds[1]), minlength=len(at))
        for k, s in zip(some, listed(found, _tables(kinds), kinds), strict=True):
            digests[k] = hashlib.sha256(s).hexdigest()
            strings[k] = str(s, "ascii") if with_groups else ""
    edge = pa.array(np.append(0, np.cumsum(per_text)), pa.int32())
    columns = [*(pa.array(f) for f in figures), pa.array(strings), pa.array(digests)]
    return columns, pa.ListArray.from_arrays(edge, pa.array(pair)), pa.ListArray.from_arrays(edge, pa.array(count, pa.int64()))


def _align(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], with_groups: bool) -> Iterator[pa.RecordBatch]:
    sides = (byte_level(paths[0]), sentence_pieces(paths[1]))
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            part = batch.slice(at, upto - at)
            columns, pairs, counts = _slice(part.column("text").to_pylist(), sides, with_groups)
            numbers = pa.array(row + np.arange(at, upto))
            yield pa.RecordBatch.from_arrays([numbers, part.column("id"), *columns, pairs, counts], ["row", "id", *(n for n, _ in _SCHEMA), "pairs", "counts"])
            at = upto
        row += batch.num_rows


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (BYTE_LEVEL, PIECES), with_groups: bool = True) -> DataFrame:
    """One row per input row: row (a number of its own), id, n_a, n_b, n_groups, n_links, groups (the string of them,
    empty unless with_groups), groups_sha256, and the document's different pairs with their counts.

    A text that is null or empty, or whose bytes either tokenizer doesn't give back, has no tokens: zeros, an empty
    string for the digest and no pairs. Texts are read whole; repeated rows and ids, null ones too, are rows like
    any other; an empty table gives none. No column but id and text is read, so none can clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = picked(docs, id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(partial(_align, paths=paths, with_groups=with_groups), f"row bigint, id {kind}, {_DDL}, pairs array<bigint>, counts array<bigint>").withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, kinds_b: int) -> DataFrame:
    """How many rows of `aligned` hold each pair, and whether that is the highest of the pair's A id (ties included)."""
    held = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held"))
    held = save(held.withColumn("a", F.expr(f"pair div {kinds_b}")), "pair-counts")
    best = held.groupBy("a").agg(F.max("held").alias("most"))
    return held.join(best, "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per row of `aligned` that has a link: n_best and count_sum over its links.

    Where there are more than `most_pairs` different pairs, those in so many documents that at most `most_pairs` can
    be (links over that number) are broadcast, so that no pair of many documents is a join key; the rest are joined.
    """
    counts = save(counts, "pair-best")
    pairs = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("times"))
    figures = counts.agg(F.count("*").alias("n"), F.sum("held").alias("links")).first()
    if figures.n <= most_pairs:
        joined = pairs.join(F.broadcast(counts), "pair")
    else:
        heavy = figures.links // most_pairs + 1
        often = counts.filter(F.col("held") >= heavy)
        known = pairs.join(F.broadcast(often.withColumnsRenamed({"held": "held_often", "best": "best_often"})), "pair", "left")
        light = known.filter("held_often IS NULL").select("row", "pair", "times").join(counts.filter(F.col("held") < heavy), "pair")
        joined = light.select("row", "times", "held", "best").unionByName(known.filter("held_often IS NOT NULL").select("row", "times", F.col("held_often").alias("held"), F.col("best_often").alias("best")))
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))


def op13_align(spark, sf_dir: str) -> DataFrame:
    aligned = save(align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_groups=False), "aligned", compression="zstd")
    sums = link_sums(aligned, pair_counts(aligned, len(sentence_pieces(PIECES).pieces)))
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
