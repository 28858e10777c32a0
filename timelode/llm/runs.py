"""Periodic runs in the words of a text, found on a Re-Pair grammar, and the texts without the repetitions.

A run is a stretch of consecutive words with smallest period q, of at least max(LEAST, 2 q) words, that no
neighbouring word extends. All texts of a slice share one grammar:

1. A run of LEAST words has LEAST / 2 words in a row that come again q words on, so every word of a run stands in
   a window of LEAST / 2 words that the text repeats. Words in no such window are where no run can pass; the
   stretches between them are the segments.
2. Re-Pair over the word ids of the segments: in each round the pairs that are more frequent than the pairs they
   overlap are replaced together by nonterminals. What is left of a segment is the start of a balanced tree.
3. A run lies whole in the expansion of the smallest node around it, and crosses the boundary between that node's
   two children. So for each node once, whatever the number of its places, each further place of the word at the
   boundary gives a period, and common extensions to both sides, found by ranks of doubling length, the interval.
4. Intervals are carried down to all places of their nodes; intervals of one period that meet are merged, and
   of one interval's periods the smallest counts.

Memory follows a slice of SLICE_WORDS words or the longest text; no row depends on another, so there is no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import picked

#: Words of the shortest run.
LEAST = 12
#: Words that are looked at together: whole texts up to this many words, or one longer text.
SLICE_WORDS = 200_000

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))[:-1]


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [begin, begin + count): the number of the range, and each of its members."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(_starts(count), count) + begin[of]


def segments(hashes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where a run may be; hashes may collide, which only lengthens a stretch."""
    window, n = least // 2, len(hashes)
    text = np.repeat(np.arange(len(lengths)), lengths)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (text[: n - window + 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):
        mixed = (mixed ^ hashes[k : n - window + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    order = np.argsort(mixed[at], kind="stable")
    same = np.diff(mixed[at][order]) == 0
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + window, -1)
    covered = np.cumsum(step[:-1]) > 0
    fresh = np.ones(n, bool)
    fresh[1:] = (text[1:] != text[:-1]) | ~covered[:-1]
    begin = np.flatnonzero(covered & fresh)
    last = np.ones(n, bool)
    last[:-1] = fresh[1:] | ~covered[1:]
    end = np.flatnonzero(covered & last) + 1
    long = end - begin >= least
    return begin[long], end[long]


class Grammar:
    """Nodes above the words of `word`: children, lengths, a place of each, and the root of every segment.

    `word` holds ids below `kinds`; where `fence` is set stands an id of its own that ends a segment.
    """

    def __init__(self, word: np.ndarray, kinds: int, fence: np.ndarray):
        self.word, self.base = word, kinds
        self.left = [np.zeros(0, np.int64)]
        self.right, self.place = list(self.left), list(self.left)
        self.length = np.ones(kinds, np.int64)
        symbol, place = self._pairs(word.copy(), np.arange(len(word)))
        self._roots(symbol, place, fence)
        self.left, self.right, self.place = (np.concatenate(x) for x in (self.left, self.right, self.place))

    def _add(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        new = len(self.length) + np.arange(len(left))
        for to, value in ((self.left, left), (self.right, right), (self.place, place)):
            to.append(value)
        self.length = np.concatenate([self.length, self.length[left] + self.length[right]])
        return new

    def _pairs(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = self.base + len(symbol) + 1
        known, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = np.ones(max(0, len(symbol) - 1), bool)  # a pair that was unique stays so until a neighbour is replaced
        while may.any():
            at = np.flatnonzero(may)
            pairs, kind, count = np.unique(symbol[at] * most + symbol[at + 1], return_inverse=True, return_counts=True)
            often = count[kind] > 1
            at, kind = at[often], kind[often]
            if not len(at):
                break
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((pairs, _scrambled(pairs), np.log2(count).astype(np.int64)))] = np.arange(len(pairs))
            held = np.full(len(symbol) + 1, -1, np.int64)  # held[i + 1]: rank of the pair at i
            held[at + 1] = rank[kind]
            top = (held[at + 1] >= held[at]) & (held[at + 1] >= np.append(held, -1)[at + 2])
            at, kind = at[top], kind[top]
            follows = np.zeros(len(at), bool)  # of pairs that overlap their like every other one is replaced
            follows[1:] = np.diff(at) == 1
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            taken = (np.arange(len(at)) - first) % 2 == 0
            at, kind = at[taken], kind[taken]
            used, where, kind = np.unique(kind, return_index=True, return_inverse=True)
            key = pairs[used]
            if len(known):
                found = np.minimum(np.searchsorted(known, key), len(known) - 1)
                old = known[found] == key
            else:
                found, old = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            name = np.empty(len(key), np.int64)
            name[old] = number[found[old]]
            name[~old] = self._add(key[~old] // most, key[~old] % most, place[at[where[~old]]])
            order = np.argsort(np.concatenate([known, key[~old]]), kind="stable")
            known, number = np.concatenate([known, key[~old]])[order], np.concatenate([number, name[~old]])[order]
            symbol[at] = name[kind]
            keep, changed, again = np.ones(len(symbol), bool), np.zeros(len(symbol), bool), held[1:] >= 0
            keep[at + 1], changed[at] = False, True
            symbol, place, changed, again = symbol[keep], place[keep], changed[keep], again[keep]
            may = changed[:-1] | changed[1:] | again[:-1]
        return symbol, place

    def _roots(self, symbol: np.ndarray, place: np.ndarray, fence: np.ndarray) -> None:
        """Joins what is left of each segment two by two until it has one root."""
        segment, inner = np.cumsum(fence)[place], ~fence[place]
        symbol, place, segment = symbol[inner], place[inner], segment[inner]
        while len(symbol) and (segment[1:] == segment[:-1]).any():
            fresh = np.append(True, segment[1:] != segment[:-1])
            nth = np.arange(len(symbol)) - np.maximum.accumulate(np.where(fresh, np.arange(len(symbol)), 0))
            at = np.flatnonzero((nth[:-1] % 2 == 0) & (segment[1:] == segment[:-1]))
            symbol[at] = self._add(symbol[at], symbol[at + 1], place[at])
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, place, segment = symbol[keep], place[keep], segment[keep]
        self.root, self.root_place = symbol, place


def _scrambled(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return y ^ (y >> np.uint64(32))


class Extensions:
    """Lengths of the longest common extensions of places of a text, by ranks of stretches of doubling length."""

    def __init__(self, word: np.ndarray, longest: int):
        self.ranks, size, rank = [word.astype(np.int64)], 1, word.astype(np.int64)
        while 2 * size <= longest and len(word) >= 2 * size:
            pairs = rank[: len(rank) - size] * (int(rank.max()) + 1) + rank[size:]
            found, rank = np.unique(pairs, return_inverse=True)
            self.ranks.append(rank)
            size *= 2
            if len(found) == len(pairs):
                break

    def forward(self, x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on, x < y, before end."""
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[k], 1 << k
            while True:
                on = np.flatnonzero(y + done + size <= end)
                on = on[rank[x[on] + done[on]] == rank[y[on] + done[on]]]
                done[on] += size
                if k < len(self.ranks) - 1 or not len(on):
                    break
        return done

    def backward(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words before x equal those before y, x < y, from begin on."""
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[k], 1 << k
            while True:
                on = np.flatnonzero(x - done - size >= begin)
                on = on[rank[x[on] - done[on] - size] == rank[y[on] - done[on] - size]]
                done[on] += size
                if k < len(self.ranks) - 1 or not len(on):
                    break
        return done


def _least_period(group: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The indexes of the smallest period of each (group, begin, end)."""
    order = np.lexsort((period, end, begin, group))
    g, b, e = group[order], begin[order], end[order]
    first = np.append(True, (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (e[1:] != e[:-1])) if len(order) else np.zeros(0, bool)
    return order[first]


def _crossing(grammar: Grammar, least: int, portion: int = 500_000) -> tuple[np.ndarray, ...]:
    """Of each node the intervals that cross its boundary: node, start within it, end, period; in order of nodes."""
    node = np.flatnonzero(grammar.length[grammar.base :] >= least)
    begin = grammar.place[node]
    middle, end = begin + grammar.length[grammar.left[node]], begin + grammar.length[grammar.base + node]
    word, n = grammar.word, len(grammar.word)
    order = np.argsort(word, kind="stable")
    key = word[order] * n + order  # places of a word, ascending
    low, high = (np.searchsorted(key, word[middle] * n + edge) for edge in (begin, end))
    reach = Extensions(word, int(grammar.length.max()))
    out: list[tuple[np.ndarray, ...]] = []
    edges = np.searchsorted(np.cumsum(high - low), np.arange(0, int((high - low).sum()) + portion, portion), side="right")
    edges[-1] = len(node)
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        if a == z:
            continue
        of, k = _spread(low[a:z], (high - low)[a:z])
        of, other = of + a, order[k]
        of, other = of[other != middle[of]], other[other != middle[of]]
        x, y = np.minimum(other, middle[of]), np.maximum(other, middle[of])
        # most candidates end within a few words: those are told by single steps
        need = np.maximum(y - x, least - (y - x))
        near = np.zeros(len(x), np.int64)
        fore = back = np.arange(len(x))
        for s in range(least // 2):
            fore = fore[y[fore] + s < end[of[fore]]]
            fore = fore[word[x[fore] + s] == word[y[fore] + s]]
            near[fore] += 1
            back = back[x[back] - s - 1 >= begin[of[back]]]
            back = back[word[x[back] - s - 1] == word[y[back] - s - 1]]
            near[back] += 1
        on = near >= np.minimum(need, least // 2)
        of, x, y, need = of[on], x[on], y[on], need[on]
        fore, back = reach.forward(x, y, end[of]), reach.backward(x, y, begin[of])
        on = fore + back >= need
        of, x, y, fore, back = of[on], x[on], y[on], fore[on], back[on]
        start, stop, period = x - back - begin[of], y + fore - begin[of], y - x
        one = _least_period(of, start, stop, period)
        out.append((node[of[one]], start[one], stop[one], period[one]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))


def _everywhere(grammar: Grammar, node: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """The intervals at all places of their nodes."""
    n, base = len(grammar.left), grammar.base
    own = np.bincount(node, minlength=n)
    first = _starts(own)
    holds = np.append(np.zeros(base, bool), own > 0)
    pending = np.arange(n)
    while len(pending):  # a node holds intervals if a child does; as many rounds as the tree is deep
        pending = pending[~holds[base + pending]]
        more = pending[holds[grammar.left[pending]] | holds[grammar.right[pending]]]
        if not len(more):
            break
        holds[base + more] = True
    out = []
    symbol, place = grammar.root, grammar.root_place
    while len(symbol):
        on = holds[symbol]
        symbol, place = symbol[on] - base, place[on]
        of, k = _spread(first[symbol], own[symbol])
        out.append((place[of] + start[k], place[of] + end[k], period[k]))
        left, right = grammar.left[symbol], grammar.right[symbol]
        symbol, place = np.concatenate([left, right]), np.concatenate([place, place + grammar.length[left]])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _merged(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one period that share at least a period are one; of one interval's periods the smallest stays."""
    if not len(begin):
        return begin, end, period
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    group = np.cumsum(np.append(0, period[1:] != period[:-1]))
    span = int(end.max()) + 1
    furthest = np.maximum.accumulate(group * span + end) - group * span  # a later group starts above all earlier ones
    new = np.append(True, (group[1:] != group[:-1]) | (begin[1:] + period[1:] > furthest[:-1]))
    head = np.flatnonzero(new)
    begin, period, end = begin[head], period[head], np.maximum.reduceat(end, head)
    one = _least_period(np.zeros(len(begin), np.int64), begin, end, period)
    return begin[one], end[one], period[one]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """All runs of some texts given as words: text, start, length, period, in the order of text, start, period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n, nothing = int(lengths.sum()), (np.zeros(0, np.int64),) * 4
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, n).view(np.uint64)
    begin, end = segments(hashes, lengths, least)
    if not len(begin):
        return nothing
    offset = _starts(lengths)
    text = np.searchsorted(offset + lengths, begin, side="right")
    ids: dict[bytes, int] = {}
    size = end - begin
    fence = np.zeros(int(size.sum()) + len(size), bool)
    fence[np.cumsum(size + 1) - 1] = True
    word = np.empty(len(fence), np.int64)
    word[~fence] = np.fromiter((ids.setdefault(w, len(ids)) for t, b, e in zip(text, begin - offset[text], end - offset[text], strict=True) for w in texts[t][b:e]), np.int64, int(size.sum()))
    word[fence] = len(ids) + np.arange(len(size))
    grammar = Grammar(word, len(ids) + len(size), fence)
    a, z, period = _merged(*_everywhere(grammar, *_crossing(grammar, least)))
    segment = np.cumsum(fence)[a]
    a, length = a - _starts(size + 1)[segment] + begin[segment], z - a
    text = text[segment]
    order = np.lexsort((period, a, text))
    return text[order], (a - offset[text])[order], length[order], period[order]


def words_of(text: str | None) -> list[bytes]:
    """What stands between ASCII blanks (U+0009 to U+000D and U+0020), in UTF-8."""
    return (text or "").encode().split()


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
    """The words joined by blanks, without those that any run holds behind its first period."""
    if not len(start):
        return b" ".join(words).decode()
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]).decode()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(ids: list, texts: list[list[bytes]], least: int, kind: pa.DataType) -> pa.RecordBatch:
    text, *found = runs_of(texts, least)
    edge = np.searchsorted(text, np.arange(len(texts) + 1))
    runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in found], fields=list(_RUN)))
    plain = [collapsed(t, *(x[a:z] for x in found)) for t, a, z in zip(texts, edge[:-1], edge[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), runs, pa.array(plain, pa.string())], ["id", "runs", "collapsed"])


def _find(batches: Iterator[pa.RecordBatch], least: int, rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, ids, texts, held = batch.schema.field("id").type, [], [], 0
        for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
            words = words_of(text.as_py())
            if texts and held + len(words) > SLICE_WORDS:
                yield _batch(ids, texts, least, kind)
                ids, texts, held = [], [], 0
            ids.append(i.as_py())
            texts.append(rewrite(i.as_py(), words) if rewrite else words)
            held += len(words)
        if texts:
            yield _batch(ids, texts, least, kind)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per input row: id, runs (start, length, period; by start, then period) and the collapsed text.

    rewrite, if given, gets (id, words) and returns the words to look at. `least` is even. A null or empty text, and
    one of blanks, has no runs and collapses to an empty text; texts are read whole, in time n log n of their words.
    Repeated rows and ids, null ones too, get a result each; an empty table gives no rows. No column of the input
    but id and text is read, so none can clash.
    """
    if least < 4 or least % 2:
        raise ValueError("least must be an even number of words, four at least")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = picked(docs, id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(partial(_find, least=least, rewrite=rewrite), f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("id", id_col)


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: one document in ten, by the CRC of its id, gets a periodic tail. A null id gets none."""
    if doc_id is None or not words or (h := zlib.crc32(b"%d" % doc_id)) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_runs(spark, sf_dir: str) -> DataFrame:
    found = collapse_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=periodic_tail)
    runs = F.col("runs")
    ahead = lambda x, y: F.when((x["length"] > y["length"]) | ((x["length"] == y["length"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))), -1).otherwise(1)
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.get(F.array_sort(runs, ahead), 0)
    return found.withColumn("best", best).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
