"""PII, licences, exact copies, SimHash, lines: against plain versions on small tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from timelode.llm import exact, licenses, lines, pii, similar, simhash

TEXTS = [
    None, "", " ", "a@b.c_d@e.fr and x@y", "@a.b a@@b.c", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 01.02.03.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "x 5500005555555559 y", "12 4111111111111111",
    "+1 (555) 010-9999 now", "+1 2 3", "++49 170 1234567.", "café a@b.co 10.0.0.1", "DE89370400440532013000 and DE89370400440532013001", "ssn 123-45-6789", "123-45-6789", "1" * 5000, *[".".join(["0" * 5000 + "7" if i == k else "1" for i in range(4)]) for k in range(4)], "0" * 4299 + ".1.2.256", "a" * 5000 + "@", "word " * 3000 + "z@z.zz",
]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p.lstrip("0")[:9] or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "id", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, id string, spans int")


def test_pii(docs):
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = plain_spans(t)
        assert [(s.kind, s.start, s.end) for s in got[i].spans if s.kind in pii.BASE_KINDS] == want, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    kinds = lambda t: [s.kind for s in got[TEXTS.index(t)].spans]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("123-45-6789") == []
    assert kinds("DE89370400440532013000 and DE89370400440532013001") == ["iban"]


def test_ibans_end_where_they_fit():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for after in ("", " BIC COBADEFFXXX", " 2024", " EUR 12", ". Then", " to me", f" {gb}"):
        found = [f"IBAN {de}{after}"[a:b] for k, a, b, _ in pii.spans_of(f"IBAN {de}{after}") if k == "iban"]
        assert found == ([de, gb] if gb in after else [de])
    for text in ("DE89 3704 0044 0532 0130 01 BIC", "DE89 3704 0044 0532 0130 00X", f"A{gb}", f"{gb}7"):
        assert not [s for s in pii.spans_of(text) if s[0] == "iban"]


def test_redaction(docs):
    found = docs.drop("spans").join(pii.find_pii(docs), "doc_id").filter("doc_id = 13")
    assert found.select(pii.redacted(found["text"], found["spans"])).first()[0] == "café [EMAIL] [IP]"


def test_empty_tables(docs):
    none = docs.filter("doc_id < 0").selectExpr("doc_id", "text", "'h' source")
    for f in (pii.find_pii, licenses.scan_licenses, exact.exact_dedup, simhash.near_duplicates, similar.similar_groups, lines.drop_boilerplate):
        assert f(none).count() == 0


LICENSES = [
    (None, [], 0, None), ("Under the MIT  License, under-the mit license", ["mit"], 2, (0, 4)), ("apache license, VERSION 2.0", ["apache-2"], 1, (0, 0)), ("under the mit licenses", [], 0, None), ("Licensed under CC BY-NC 4.0", ["cc-by-nc"], 1, (2, 2)),
    ("é under the mit license", ["mit"], 1, (1, 1)), ("under the mit license under the mit license", ["mit"], 2, (0, 4)),
]


def test_licenses(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LICENSES)], "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        text, base, n, places = LICENSES[r.doc_id]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        assert (r.n_words, r.base_labels, r.n_base) == (len(words), base, n)
        assert (r.first_word, r.last_word) == (places or (None, None))


def test_license_expressions():
    assert licenses.postfix("(a or b) and c with d") == ["a", "b", "or", "c", "d", "with", "and"]
    assert licenses.evaluate("(gpl-2.0-only or mit) and bsd-3-clause with x")[0] == {"gpl-2", "mit", "bsd"}
    both = {"mit", "apache-2"}
    assert licenses.evaluate("mit and apache-2.0") == (both, both) and licenses.evaluate("mit or apache-2.0") == (both, set())
    assert licenses.evaluate("(mit or isc) and (mit or bsd)") == ({"mit", "isc", "bsd"}, set()) and licenses.evaluate("mit and isc or mit")[1] == {"mit"}
    scans = [licenses.scan(f"SPDX-License-Identifier: MIT {op} Apache-2.0".encode()) for op in ("OR", "AND")]
    assert [x["labels"] for x in scans] == [["apache-2", "mit"]] * 2 and [x["required"] for x in scans] == [[], ["apache-2", "mit"]]
    for broken in ("", "and", "(", ")", "mit and", "mit mit", "((mit)"):
        licenses.evaluate(broken)
    assert "mit" in licenses.scan(b"x\nSPDX-License-Identifier: MIT OR Apache-2.0\n")["labels"]


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = sorted((i, label) for phrase, label in licenses.BASE_PHRASES.items() for k in [phrase.split()] for i in range(len(words)) if words[i : i + len(k)] == k)
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x[1] for x in found}))


def test_license_query(spark, tmp_path):
    """The query on random texts, null, empty, very long and repeated ones, against a plain loop."""
    rng = np.random.default_rng(11)
    pieces = ["under the MIT license", "Under", "the", "mit", "license", "apache license", "version 2", "cc by-nc", "CC", "by", "nc", "é", "ünder", ".", "\n", "all rights reserved", "x:"]
    texts = [" ".join(rng.choice(pieces, n)) for n in rng.integers(0, 40, 300)] + [None, "", "word " * 300_000 + "under the mit license", "under the mit license " * 20_000, "SPDX-License-Identifier: " * 20_000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string, id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op9_licenses(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_expressions_of_any_length():
    many = [f"x-{i}-1.0" for i in range(300)]
    line = f"# SPDX-License-Identifier: {' AND '.join(many)} AND (GPL-2.0-only OR MIT)".encode()
    got = licenses.scan(line + b" is what holds\nand isc")["labels"]
    assert len(line) > 400 and got == sorted([*many, "gpl-2", "mit"])
    assert licenses.scan(f"{'SPDX-License-Identifier: MIT OR ISC; ' * 3}".encode())["labels"] == ["isc", "mit"]


def test_exact(spark):
    rows = [(1, "A"), (2, "a"), (3, "á"), (4, "Á"), (5, None), (6, ""), (7, "b"), (7, "b"), (None, "c"), (9, "x" * 100_000), (10, "X" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS copies")
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(df).collect()))
    assert got == [(0, None, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 2, True), (7, 7, 2, True), (9, 10, 2, False), (10, 10, 2, True)]
    assert {r.keep_id for r in exact.exact_dedup(df.filter("doc_id < 3"), keep="smallest").collect()} == {1}


def test_exact_with_colliding_keys(spark, monkeypatch):
    """Texts whose keys collide are told apart by their bytes."""
    monkeypatch.setattr(exact, "_keys", lambda digests: np.zeros(len(digests), dtype=np.int64))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(exact)
    try:
        df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "c")], "doc_id long, text string").coalesce(1)
        got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(df).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(exact)
    assert got == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]


@pytest.mark.parametrize("filtered", [64, 2])
def test_exact_with_many_runs(spark, monkeypatch, filtered):
    """Whether the filters of all runs fit a worker or not, the texts are scanned once and the result is the same."""
    monkeypatch.setattr(exact, "RUN_KEYS", 3)
    monkeypatch.setattr(exact, "FILTERED_RUNS", filtered)
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(100)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(df).collect()}
    assert got == {i: (i % 40 + (80 if i % 40 < 20 else 40), 3 if i % 40 < 20 else 2) for i in range(100)}


def test_filters_of_runs():
    rng = np.random.default_rng(12)
    keys, others = (rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64) for _ in range(2))
    filters = {}
    for run in range(3):
        bits = np.zeros(exact.FILTER_BITS, dtype=bool)
        bits[exact._positions(keys[exact._run_of(keys, 3) == run]).ravel()] = True
        filters[run] = np.packbits(bits, bitorder="little")
    assert exact.might_hold(filters, keys, 3).all() and exact.might_hold(filters, others, 3).mean() < 0.01
    assert not exact.might_hold({}, keys, 3).any()


def test_runs_are_sorted_and_merged(spark):
    log = spark.createDataFrame([(i % 5, i) for i in range(50)], "key long, best long").coalesce(1)
    runs = exact.flush_runs(log)
    assert [tuple(r) for r in runs.collect()] == [(k, k, 10) for k in range(5)]
    assert sorted(tuple(r) for r in exact.compact(runs, runs).collect()) == [(k, k, 20) for k in range(5)]


def plain_simhash(text, k):
    words = [w for w in re.split(b"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(400)], n)) for n in rng.integers(1, 120, 60)]
    texts += [t + " extra" for t in texts[:20]] + [t.upper() for t in texts[:5]] + [None, "", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS node")
    prints = [plain_simhash(t, 3) for t in texts]
    label = list(range(len(texts)))
    for _ in label:
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (prints[i], label[i]) for i in range(len(texts))}


@pytest.mark.parametrize("radius", [2, 3])
def test_golay_keys_meet(radius):
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    flips = np.array([np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.choice(64, rng.integers(0, radius + 1), replace=False))) for _ in a])
    home, probe = simhash.golay_keys(a, False, radius), simhash.golay_keys(a ^ flips, True, radius)
    assert len({r for r, _ in set(zip(*map(np.ndarray.tolist, home), strict=True)) & set(zip(*map(np.ndarray.tolist, probe), strict=True))}) == len(a)


def test_golay_code_is_perfect():
    assert set(np.bincount(simhash.decoder(), minlength=4096)) == {2048}


def test_crowded_keys_lose_no_component(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 4)
    prints = sorted({int(b ^ (1 << int(i)) ^ (1 << int(j))) for b in base for i, j in rng.integers(0, 62, (60, 2))})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    one, other = (sorted(tuple(r) for r in simhash.connected_components(simhash.fingerprint_links(df, limit)).collect()) for limit in (10**6, 2))
    assert one == other


def test_keys_crowded_with_probes(spark, monkeypatch):
    """One home row under a key that many probe: the key counts as crowded, and no component is lost."""
    home = 0b1011 << 30
    prints = sorted({home} | {home ^ (1 << i) ^ (1 << j) for i in range(22, 43) for j in range(i)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    one = sorted(tuple(r) for r in simhash.connected_components(simhash.fingerprint_links(df, 10**6)).collect())
    monkeypatch.setattr(simhash, "PROBES_A_HOME", 0)
    links = simhash.fingerprint_links(df, 10**6)
    assert sorted(tuple(r) for r in simhash.connected_components(links).collect()) == one


def test_similar_groups(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(2000)]
    base = [list(rng.choice(words, 200)) for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:100], "changed", *b[101:]]) for b in base[:10]] + [" ".join(b).upper() for b in base[:3]] + ["a b", "b a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (64, 1):
        got = {r.doc_id: r.component_id for r in similar.similar_groups(df, bucket_limit=limit).collect()}
        assert got == {**{i: i for i in range(20)}, **{20 + i: i for i in range(10)}, 30: 0, 31: 1, 32: 2, 33: 33, 34: 34, 35: 35, 36: 35}


def test_similar_groups_with_shared_ids(spark):
    """Of rows with one id the text with the least digest counts; repeated rows change nothing."""
    rng = np.random.default_rng(5)
    first, second = (" ".join(rng.choice([f"w{i}" for i in range(500)], 100)) for _ in range(2))
    least, most = sorted((first, second), key=lambda t: xxhash.xxh3_128_digest(t.encode()))
    rows = [(7, most), (7, least), (7, least), (3, f"{least} end"), (4, f"{most} end"), (9, least.upper()), (9, least.upper()), (None, least)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.similar_groups(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (4, 4), (7, 3), (9, 3)]


def test_similar_groups_finds_every_kind_of_edit(spark):
    """Appended and replaced passages, cut ends and scattered edits down to a similarity of exactly 0.8."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rank = 1 / np.arange(1, 3001)
    texts = []
    for i in range(60):
        base = list(rng.choice(words, 204, p=rank / rank.sum()))
        fresh = [f"n{i}x{j}" for j in range(60)]
        texts += [base, [base + fresh[:48], base + fresh[:22], base[:165], base[:80] + fresh[:16] + base[96:], base[:60] + fresh[:1] + base[61:]][i % 5]]
    texts += [[f"e{j}" for j in range(n)] for n in (14, 12, 19, 16)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    reach = list(range(len(sets)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                    reach[i] = reach[j] = min(reach[i], reach[j])
    assert sum(r != i for i, r in enumerate(reach)) >= 60
    for limit in (16, 1):
        got = {r.doc_id: r.component_id for r in similar.similar_groups(df, bucket_limit=limit).collect()}
        assert [got[i] for i in range(len(texts))] == reach


@pytest.mark.parametrize("cell", [5, 16_384])
def test_similar_texts_under_a_key_dealt_to_cells(spark, monkeypatch, cell):
    """Texts that share a rare passage but little else, with pairs among them: one key holds them all, in one cell or in many."""
    monkeypatch.setattr(similar, "DEALT", cell)
    monkeypatch.setattr(similar, "COMMON_TEXTS", 10**6)  # no shingle counts as common, so the passage's are among the keys
    crowds, dealt = [], similar._dealt
    monkeypatch.setattr(similar, "_dealt", lambda *sides: crowds.append(sides[2].agg({"n": "max"}).first()[0]) or dealt(*sides))
    passage = [f"p{j}" for j in range(12)]
    own = [[f"o{i}x{j}" for j in range(40)] for i in range(24)]
    texts = [passage + o for o in own] + [passage + o[:38] for o in own[::2]] + [o[:3] + passage + o[3:] for o in own[:4]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    reach = list(range(len(sets)))
    for _ in range(3):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                    reach[i] = reach[j] = min(reach[i], reach[j])
    assert sum(r != i for i, r in enumerate(reach)) >= 12
    rows = spark.createDataFrame([(1, i, "x") for i in range(30)], "key long, node long, component string")
    of_key = spark.createDataFrame([(1, 30, 12)], "key long, n long, apart long")
    side, other = dealt(rows.filter("node < 12"), rows, of_key)
    met = side.alias("h").join(other.alias("p"), ["key", "cell"]).selectExpr("h.node AS a", "p.node AS b").collect()
    assert sorted((r.a, r.b) for r in met) == [(a, b) for a in range(12) for b in range(30)]
    got = {r.doc_id: r.component_id for r in similar.similar_groups(df, bucket_limit=1).collect()}
    assert [got[i] for i in range(len(texts))] == reach and max(crowds) > 10


def test_lines(spark):
    page = lambda i, host, *more: (i, host, "\n".join(["  Cookie notice ", *more, f"own {i}"]), 5)
    rows = [page(i, "a", "", "often" if i < 3 else "") for i in range(30)] + [page(100 + i, "b") for i in range(10)] + [(200, None, None, 1), (201, "a", "Cookie notice", 1), (202, "a", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, host int")
    got = {r.doc_id: r for r in lines.drop_boilerplate(df, min_pages=11).collect()}
    assert got[0].text == "\noften\nown 0" and got[0]["_n_lines"] == 4 and got[0]["_n_dropped"] == 1
    assert got[100].text == rows[30][2]  # too few pages on that host
    assert got[200].text is None and got[201].text == "" and got[202].text == "" and len(got) == len(rows)
    assert got[0].host == 5
    # a host of ten pages is cleaned as well: what stands on two of them exceeds a tenth, what stands on one is no repetition
    few = {r.doc_id: r for r in lines.drop_boilerplate(df).collect()}
    assert few[100].text == "own 100" and few[100]["_n_dropped"] == 1 and few[0].text == got[0].text
    odd = df.selectExpr("*", "1 AS _bad", "2 AS _n_dropped", "3 AS _host", "4 AS `a.b`")
    assert lines.drop_boilerplate(odd, counts=("n1", "n2")).filter("doc_id = 100").select("_bad", "_n_dropped", "`a.b`", "n2").first() == (1, 2, 4, 1)


def test_share_at_the_ratio(spark):
    """Ten of a hundred pages are not more than a tenth, eleven are."""
    rows = [(i, "h", f"own {i}\n{'ten' if i < 10 else ''}\n{'eleven' if i < 11 else ''}") for i in range(100)]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).filter("doc_id = 0").first()
    assert got.text == "own 0\nten" and got["_n_dropped"] == 1


@pytest.mark.parametrize(
    ("text", "labels", "required"),
    [
        ("/* SPDX-License-Identifier: GPL-2.0 */ and the rest", {"gpl-2"}, {"gpl-2"}),
        ("SPDX-License-Identifier: MIT. Or contact us", {"mit"}, {"mit"}),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0", {"mit", "apache-2"}, {"mit", "apache-2"}),
        ("SPDX-License-Identifier: MIT or SPDX-License-Identifier: Zlib", {"mit", "zlib"}, {"mit", "zlib"}),
        ("SPDX-License-Identifier: MIT, or Zlib", {"mit"}, {"mit"}),
        ("SPDX-License-Identifier: GPL-2.0 and the rest", {"gpl-2"}, {"gpl-2"}),
        ("# SPDX-License-Identifier: (MIT OR Zlib) AND X11-like", {"mit", "zlib", "x11-like"}, {"x11-like"}),
        ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 -- see file", {"gpl-2"}, {"gpl-2"}),
        ("SPDX-License-Identifier:", set(), set()),
        ("SPDX-License-Identifier: */ MIT", set(), set()),
    ],
)
def test_expressions_end_where_they_end(text, labels, required):
    found = licenses.scan(text.encode())
    assert set(found["labels"]) == labels and set(found["required"]) == required


def test_context_words_are_whole_words():
    ssn = lambda t: [s[:3] for s in pii.spans_of(t) if s[0] == "ssn"]
    assert ssn("The syntax of 123-45-6789") == [] and ssn("taxi 123-45-6789") == [] and ssn(f"{'x' * 60}syntax{' ' * 37}123-45-6789") == []
    assert ssn("tax 123-45-6789") == [("ssn", 4, 15)] and ssn("123-45-6789 (SSN)") == [("ssn", 0, 11)] and ssn(f"tax{' ' * 37}123-45-6789") == [("ssn", 40, 51)]
    assert ssn("tax serial 123-45-6789") == [] and ssn("serial tax 123-45-6789 ") == []
    near, far = (pii.score(t, "phone", t.index("+"), len(t)) for t in ("phone +49301234567", f"phone{' ' * 30}+49301234567"))
    assert 0.6 < far < near <= 1.0 and pii.score("ship 1.2.3.4", "ip", 5, 12) == pii.PRIOR["ip"] and pii.score("version 1.2.3.4", "ip", 8, 15) < pii.PRIOR["ip"]
