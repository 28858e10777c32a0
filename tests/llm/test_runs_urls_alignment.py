"""Periodic runs, URL filters and cross-tokenizer alignment: operators and queries against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelode.llm import align, runs, urls
from timelode.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain_runs(words, least=12):
    """For every period the stretches of equal words that far apart; of one stretch the smallest period."""
    ids, found = {}, {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    for q in range(1, len(words) // 2 + 1):
        steps = np.diff(np.concatenate(([0], (a[:-q] == a[q:]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts_with_runs(rnd):
    for _ in range(rnd.randint(1, 6)):
        kinds, n = rnd.choice([1, 2, 3, 5, 50]), rnd.randint(0, rnd.choice([15, 60, 300]))
        words = [b"w%d" % rnd.randrange(kinds) for _ in range(n)]
        if words and rnd.random() < 0.6:
            a = rnd.randrange(len(words))
            p = rnd.randint(1, max(1, (len(words) - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        if words and rnd.random() < 0.3:
            words = words + words[len(words) // 3 :] + words
        yield words
    x, y = [b"a"], [b"a", b"b"]  # words of Fibonacci hold runs within runs
    for _ in range(rnd.randint(3, 10)):
        x, y = y, y + x
    yield y


@pytest.mark.parametrize("least", [4, 12])
def test_runs_against_all_periods(least):
    rnd = random.Random(least)
    for _ in range(250):
        texts = list(texts_with_runs(rnd))
        text, *found = runs.runs_of(texts, least)
        got = [[] for _ in texts]
        for t, *r in zip(text.tolist(), *(x.tolist() for x in found), strict=True):
            got[t].append(tuple(r))
        assert got == [plain_runs(w, least) for w in texts]


def test_grammar_gives_its_words_back_and_stays_small():
    passage = [f"p{i}".encode() for i in range(3000)]
    words = passage * 8 + [b"end"]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    word = np.array([ids[w] for w in words] + [len(ids)])
    fence = np.arange(len(word)) == len(words)
    grammar = runs.Grammar(word, len(ids) + 1, fence)

    def expand(symbol):
        return [symbol] if symbol < grammar.base else expand(grammar.left[symbol - grammar.base]) + expand(grammar.right[symbol - grammar.base])

    assert len(grammar.root) == 1 and expand(grammar.root[0]) == word[:-1].tolist()
    assert len(grammar.left) < 1.2 * len(passage)  # the passage is held once
    assert plain_runs(words) == [(0, 24000, 3000)] == list(zip(*(r.tolist() for r in runs.runs_of([words])[1:]), strict=True))


def test_collapse_runs_odd_rows(spark):
    rows = [(1, "x a b a b a b a b a b a b y", 0), (1, "x a b a b a b a b a b a b y", 1), (None, "a " * 40, 2), (2, None, 3), (3, "", 4), (4, " \n\t", 5), (5, "a\x1fb é　x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("a.b", F.lit(1)).withColumn("collapsed", F.lit(2))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse_runs(df).collect()), key=repr)
    assert got == sorted([(1, [(1, 12, 2)], "x a b y")] * 2 + [(None, [(0, 40, 1)], "a"), (2, [], ""), (3, [], ""), (4, [], ""), (5, [], "a\x1fb é　x")], key=repr)
    assert runs.collapse_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(df, least=7)


@needs_data
def test_op11_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_runs"](spark, DATA).collect()}
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        seen += bool(found)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert seen > 5


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path, rules=urls.RULES):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://example.org/en/2", "http://notexample.org/es/", "https://x.com?/de/", "https://x.com/de", "https://x.com/de/#/fr/",
    "a://b://c.org/d", "http://org/", "http://ÄÖ.com/de/ü", "http://x.net:80/a", "http://user@h.com/fr/q", "http://x.com/fr/\n?a", "ftp://x.com/" + "y" * 100_000,
]


def test_rules_and_odd_urls(spark):
    weights = urls.fit(["a.com", "b.net"], ["/good/x", "/bad/y"], [False, True])
    rows = [(i, u, "n", i) for i, u in enumerate(ODD_URLS)] + [(None, "http://x.org/", "n", 1), (0, None, "n", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score int").withColumn("a.b", F.lit(1))
    got = urls.judge(df, weights).collect()
    assert len(got) == len(rows) and urls.judge(df.limit(0), weights).count() == 0
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for i, u, *_ in rows:
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path)
        for r in by_id[i]:
            assert (r.host, r.path, r.rule) == (host, path, rule) and 0 <= r.score <= 1
            assert r.verdict == (verdict or ("block" if r.score >= urls.BOUND else "allow"))
    assert len({r.score for r in by_id[0]}) == 1  # null urls are judged alike


def test_ties_of_rules(spark):
    rules = (("allow", "a.b", "/ccc"), ("block", "a.b", "/ccc"), ("allow", "b", "/ccc/d"), ("block", "x.y", "/"))
    got = urls.add_host_path(spark.createDataFrame([("http://a.b/ccc/d",), ("http://a.b/ccc",), ("http://y/",)], "url string"), "url")
    assert [r.r for r in got.select(urls.rule_of(F.col("host"), F.col("path"), rules).alias("r")).collect()] == [("a.b/ccc", "block")] * 2 + [None]


def test_features_are_those_of_each_url_alone():
    hosts, paths = ["a.example.com", "", "ü.org", "a.example.com"], ["/de/1", "", "/", "/de/1"]
    row, cell = urls.features(hosts, paths)
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        assert (urls.features([h], [p])[1] == cell[row == i]).all() and (len(cell[row == i]) > 0)
    assert not np.array_equal(urls.features(["abc"], [""])[1], urls.features([""], ["abc"])[1])  # host and path are told apart


def test_model_learns_and_is_stable(spark):
    rnd = random.Random(5)
    rows = [(f"http://{rnd.choice(['shop', 'news'])}{rnd.randrange(50)}.net/{k}/{rnd.randrange(10**6)}", "block" if k in ("casino", "win") else "allow") for k in rnd.choices(["casino", "win", "article", "wiki"], k=1500)]
    df = spark.createDataFrame([*rows, (None, "allow"), ("http://x.net/casino/1", None), ("http://x.net/wiki/1", "other")], "url string, verdict string")
    weights = urls.train(df, sample=400)
    again = urls.train(df.repartition(7).orderBy(F.rand(3)), sample=400)
    assert np.array_equal(weights, again)
    split = [plain_url(u) for u, _ in rows]
    said = urls.probabilities(weights, [h for h, _ in split], [p for _, p in split]) >= urls.BOUND
    assert np.mean(said == np.array([v == "block" for _, v in rows])) > 0.98
    one = urls.train(df.filter("verdict = 'allow'"))
    assert (urls.probabilities(one, ["x"], ["/casino/"]) < 0.5).all() and (urls.probabilities(urls.train(df.limit(0)), [""], [""]) < 0.5).all()


@needs_data
def test_op12_against_plain_rules(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in QUERIES["op12_urls"](spark, DATA).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = plain_url(p.url)
        rule, verdict = plain_rule(host, path)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= urls.BOUND else "allow"))


def test_model_of_the_labelled_table(spark):
    """Hosts that stand in no row of the table: junk is blocked, invented names are not, whatever the path."""
    labelled = urls.labelled_urls(spark)
    weights = urls.train(labelled)
    junk, fine = ["m.casino-win.x.com", "free-bets.x.net", "www.spam-farm.x.com", "www.cheap-pills.x.org", "blog.adult-x.y.net", "m.ads-track.x.com"], ["tionsh.x.net", "blog.ththth.x.com", "www.stadtbuecherei.de", "m.therer.x.net", "cityarchive.x.com", "ththon.x.com"]
    for path in ("/de/217", "/en/1143.html", "/fr/9/", ""):
        assert (urls.probabilities(weights, junk, [path] * 6) >= urls.BOUND).all() and (urls.probabilities(weights, fine, [path] * 6) < urls.BOUND).all()
    part = F.abs(F.xxhash64("url")) % 4
    held = urls.add_host_path(labelled.filter(part == 0), "url").collect()
    said = urls.probabilities(urls.train(labelled.filter(part != 0)), [r.host for r in held], [r.path for r in held]) >= urls.BOUND
    assert len(held) > 80 and np.mean(said == np.array([r.verdict == "block" for r in held])) > 0.85


needs_tokenizers = pytest.mark.skipif(not os.path.isfile(align.BYTE_LEVEL), reason="the tokenizers are not here")


@lru_cache(1)
def byte_level_tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(align.BYTE_LEVEL)
    found.encode_special_tokens = True
    return found


@lru_cache(1000)
def plain_alignment(text):
    """Counts, groups and links by comparing all tokens; None where there are no tokens."""
    if not text:
        return None
    found, pieces = byte_level_tokenizer(), (align.byte_level(align.BYTE_LEVEL).pieces, align.sentence_pieces(align.PIECES).pieces)
    ids = found.encode(f" {text}", add_special_tokens=False).ids, align.sentence_pieces(align.PIECES).encode([text])[0]
    spans = []
    for side, names in zip(ids, pieces, strict=True):
        if b"".join(names[i] for i in side) != f" {text}".encode():
            return None
        end = np.cumsum([len(names[i]) for i in side]).tolist()
        spans.append(list(zip([0, *end], end, side, strict=False)))
    groups, low = [], 0
    for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
        groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
        low = cut
    links = Counter((i, j) for s, e, i in spans[0] for u, v, j in spans[1] if max(s, u) < min(e, v))
    return len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)


def odd_texts():
    rnd = random.Random(2)
    letters = [*"ab c  de1 2,.é ß\n\t\r'", "<|endoftext|>", "中", "\U0001f600", "́", "▁", "\x00", " ", "\x85", "<s>", "the ", "tion", "<0x41>", "　"]
    return [None, "", " ", "a", "▁", "<|endoftext|>", "</s>", *("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(250))]


@needs_tokenizers
def test_libraries_agree_on_common_characters():
    found, side = byte_level_tokenizer(), align.byte_level(align.BYTE_LEVEL)
    common = [chr(c) for c in range(0x180)]
    texts = [t for c in common for t in (c, c + c, f"a{c}b", f"a {c} b", f"1{c}1", f"!{c}!", f"'{c}", f" {c}x", f"{c}  {c}", f"\n{c}\n", *(f"x{c}{d}y{d}{c}" for d in common[::17]))]
    assert not any(align.ODD.search(t) for t in texts)
    assert [list(x) for x in side.encode(texts)] == [e.ids for e in found.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]


@needs_tokenizers
def test_alignment_against_all_tokens(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a text", "y"), (3, "a", "y")], "doc_id long, text string, row string").withColumn("a.b", F.lit(1))
    got = align.align_documents(df).collect()
    kinds = len(align.sentence_pieces(align.PIECES).pieces)
    assert len(got) == len(texts) + 2 and len({r.row for r in got}) == len(got) and align.align_documents(df.limit(0)).count() == 0
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[None][0].n_a > 0 and len(by_id[3]) == 2
    for i, t in enumerate(texts):
        want = plain_alignment(t)
        for r in by_id[i]:
            if want is None:
                assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.groups_sha256, r.pairs) == (0, 0, 0, 0, "", "", [])
            else:
                assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (*want[:3], sum(want[3].values()), want[4])
                assert r.groups_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
                assert {divmod(p, kinds): c for p, c in zip(r.pairs, r.counts, strict=True)} == want[3]
    assert sum(plain_alignment(t) is None for t in texts) > 5


@needs_tokenizers
@needs_data
@pytest.mark.parametrize("most_pairs", [align.MOST_PAIRS, 50])
def test_op13_against_brute_force(spark, most_pairs):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("length(text) < 2000").orderBy("doc_id").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "same text"), (-2, "same text"), (None, "same text"), (-3, "")], docs.schema))
    aligned = common_saved(align.align_documents(docs))
    kinds = len(align.sentence_pieces(align.PIECES).pieces)
    sums = {r.row: r for r in align.link_sums(aligned, align.pair_counts(aligned, kinds), most_pairs).collect()}
    rows = aligned.collect()
    texts = {d.doc_id: d.text for d in docs.collect()}
    links = [(r.row, plain_alignment(texts[r.doc_id])) for r in rows]
    held = Counter(p for _, x in links if x for p in x[3])
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    for row, x in links:
        if x is None:
            assert row not in sums
        else:
            assert sums[row].n_best == sum(n for (a, b), n in x[3].items() if held[a, b] == most[a]) and sums[row].count_sum == sum(n * held[p] for p, n in x[3].items())


def common_saved(df):
    from timelode.llm.common import save

    return save(df, "aligned")


@needs_tokenizers
@needs_data
def test_op13_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_align"](spark, DATA).collect()}
    assert got.keys() == docs.keys()
    short = sorted((i for i, t in docs.items() if t and len(t) < 800), key=lambda i: i)[:20]
    for i in short:
        want = plain_alignment(docs[i])
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (*want[:3], sum(want[3].values())) and r.groups_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert r.n_best <= r.n_links <= r.count_sum
