"""Registered queries without SQL, as they are registered, against plain versions on the smallest tables."""

import hashlib
import math
import os
import re

import pytest
import xxhash

from timelode.llm import mixing
from timelode.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, fits in rules for m in re.finditer(p, text) if fits(m[0])]


def test_op1(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op1_pii"](spark, DATA).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        want, r = base_spans(text), got[i]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(filter(None, r.spans.split(",")))


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_op2(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, DATA).collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    least = {i: i for i in docs}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    assert got == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


def test_op3(spark, docs):
    """The path that the query takes, by size: places within the sources, then every turn and slot of a plain schedule."""
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()}
    got = QUERIES["op3_mixing"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.source == source[r.doc_id] for r in got)
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    chars, blocks = {}, {}
    for s in names:
        mine, at = sorted((r.start, len(docs[r.doc_id]), r.block) for r in got if r.source == s), 0
        chars[s] = sum(n for _, n, _ in mine)
        blocks[s] = max(1, -(-chars[s] // mixing.BLOCK_CHARS))
        for start, n, block in mine:
            assert (start, block) == (at, min(at // mixing.BLOCK_CHARS, blocks[s] - 1))
            at += n
    root = {s: max(c, 1) ** mixing.TEMPERING for s, c in chars.items()}
    turns = {s: max(1, math.floor(w / sum(root.values()) * mixing.ROUND_SLOTS + 0.5)) for s, w in root.items()}
    length, done, order = sum(turns.values()), dict.fromkeys(names, 0), []
    for t in range(length):
        ready = [(-(-(done[s] + 1) * length // turns[s]), k, s) for k, s in enumerate(names) if done[s] < turns[s] and done[s] * length // turns[s] <= t]
        order.append(min(ready)[2])
        done[order[-1]] += 1
    left, at, slot, place = dict(blocks), 0, 0, {}
    while any(left.values()):
        s = order[at % length]
        if left[s]:
            place[s, blocks[s] - left[s]] = (at, slot)
            left[s], slot = left[s] - 1, slot + 1
        at += 1
    for r in got:
        assert (r.turn, r.slot) == place[r.source, r.block]
        assert r.release == r.block * length // turns[r.source] <= r.turn < r.deadline == -(-(r.block + 1) * length // turns[r.source])
