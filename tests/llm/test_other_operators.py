"""Mixing, packing, language, embeddings, archives, pipeline: against plain versions on small tables."""

import hashlib
import math
import os
import re
import time
import uuid
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from timelode.llm import common, langid, mixing, nndescent, packing, warc

DATA = "/root/testdata/sf0.001"


def mixed(spark, sizes, **kw):
    rows = [(i, s, "x" * 10, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string, bucket int"), block_chars=10, **kw).toPandas()


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 120, "c": 7, None: 40}, {"only": 25}, {f"s{i}": 10 + 7 * i for i in range(12)}])
def test_mix_keeps_shares(spark, sizes):
    got = mixed(spark, sizes, round_slots=40)
    n = sum(sizes.values())
    assert sorted(got["_slot"]) == list(range(n))  # one document a block, every slot filled once
    assert ((got["_release"] <= got["_turn"]) & (got["_turn"] < got["_deadline"])).all() and got.sort_values("_slot")["_turn"].is_monotonic_increasing
    weight = {s: max(k * 10, 1) ** 0.5 for s, k in sizes.items()}
    a = {s: max(1, int(np.floor(w / sum(weight.values()) * 40 + 0.5))) for s, w in weight.items()}
    length = sum(a.values())
    full = min(k // a[s] for s, k in sizes.items()) * length
    for s in sizes:
        mine = got[got["_source"].isna() if s is None else got["_source"] == s]["_slot"].to_numpy()
        done = np.searchsorted(np.sort(mine), np.arange(1, full + 1))
        assert np.abs(done - np.arange(1, full + 1) * a[s] / length).max(initial=0) < 1


def test_mix_given_weights_and_odd_rows(spark):
    got = mixed(spark, {"a": 100, "b": 100}, weights={"a": 3.0, "b": 1.0})
    first = got.sort_values("_slot").head(80)
    assert (first["_source"] == "a").sum() == 60
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, None, ""), (2, "a", "y" * 1000)], "doc_id long, source string, text string")
    assert mixing.mix(df, block_chars=10).count() == 4
    assert mixing.mix(df.limit(0)).count() == 0


def plain_edf(weights, n):
    """The source of each of the first n slots, by a plain loop over exact windows."""
    done, out = dict.fromkeys(weights, 0), []
    for t in range(n):
        ready = [(math.ceil((done[s] + 1) / w), k, s) for k, (s, w) in enumerate(weights.items()) if math.floor(done[s] / w) <= t]
        out.append(min(ready)[2])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.999, "b": 0.001}, {"a": 0.12345, "b": 0.87655}, {"a": "1/3", "b": "2/3"}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"a": 7, "b": 2.5, "c": 1}])
def test_mix_follows_the_given_weights_exactly(spark, weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    exact = {s: Fraction(str(w)) / total for s, w in weights.items()}
    n = 25_000 if "b" in weights and weights["b"] == 0.87655 else 2000
    got = mixed(spark, {s: math.ceil(n * w) for s, w in exact.items()}, weights=weights).sort_values("_slot").head(n)["_source"].tolist()
    assert got == plain_edf(exact, n)
    for s, w in exact.items():
        assert max(abs(k - w * (i + 1)) for i, k in enumerate(np.cumsum([x == s for x in got]).tolist())) < 1


def test_mix_many_sources(spark):
    sizes = {f"s{i:03d}": 3 + i % 5 for i in range(120)}
    got = mixed(spark, sizes, weights=dict.fromkeys(sizes, 1)).sort_values("_slot")
    assert sorted(got["_slot"]) == list(range(sum(sizes.values())))
    assert all(got["_source"].iloc[k * 120 : k * 120 + 120].nunique() == 120 for k in range(3))
    with pytest.raises(ValueError):
        mixing.parts_of({"a": 0.123456789, "b": 1})
    with pytest.raises(ValueError):
        mixing.parts_of({"a": 0, "b": 1})


def test_mix_a_thousand_sources_by_size(spark):
    """One schedule of a round serves all phases; it took over a minute for 150 sources when each phase had its own."""
    sizes = {f"s{i:04d}": 1 + i % 7 for i in range(1000)}
    began = time.time()
    got = mixed(spark, sizes, round_slots=1500)
    assert time.time() - began < 60
    assert sorted(got["_slot"]) == list(range(sum(sizes.values())))
    assert ((got["_release"] <= got["_turn"]) & (got["_turn"] < got["_deadline"])).all()


def test_mix_shuffles_a_plan_beyond_the_bound(spark, monkeypatch):
    sizes = {"a": 30, "b": 12, None: 7}
    want = mixed(spark, sizes, round_slots=40)
    monkeypatch.setattr(mixing, "PLAN_ROWS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_PHASES", 0)
    got = mixed(spark, sizes, round_slots=40)
    columns = ["_id", "_slot", "_turn", "_start"]
    assert got[columns].sort_values("_id").values.tolist() == want[columns].sort_values("_id").values.tolist()


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [*rng.integers(0, 300, 500), 5000, 4096, 4097, 0]
    df = spark.createDataFrame([(i, " ".join("w" * int(n))) for i, n in enumerate(sizes)] + [(None, None), (3, "a b")], "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS id")
    got = packing.pack_documents(df, shard_pieces=128).toPandas()
    total = got.groupby("doc_id").length.sum()
    assert all(total[i] == n + (2 if i == 3 else 0) for i, n in enumerate(sizes)) and got.doc_id.isna().sum() == 1
    for _, b in got.groupby("bin_id"):
        b = b.sort_values("bin_offset")
        assert (b.bin_offset.to_numpy() + b.length.to_numpy())[:-1].tolist() <= b.bin_offset.to_numpy()[1:].tolist()
        assert b.length.sum() <= b.bin_length.iloc[0] and b.bin_length.iloc[0] == min(c for c in packing.LENGTHS if c >= b.length.sum())
    assert packing.pack_documents(df.limit(0)).count() == 0


def cost(lengths):
    return sum(c + c * c * packing.SQUARE + packing.BIN_COST for c in lengths)


def test_packing_takes_the_cheapest_opening():
    sizes = [200] * 64
    every = [packing.best_fit(sizes, packing.LENGTHS, least)[2] for least in (None, *packing.LENGTHS)]
    assert cost(packing.pack(sizes)[2]) == min(map(cost, every)) < max(map(cost, every))
    # 1500 + 500 fill a bin of 2048, 300 + 200 one of 512: no common least length gives both
    assert sorted(packing.pack([1500, 500, 300, 200], bin_cost=100)[2]) == [512, 2048]


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_packing_against_every_partition():
    """Small inputs: never below the optimum, seldom much above it."""
    rng = np.random.default_rng(6)
    ratios = []
    for _ in range(60):
        sizes = [int(n) for n in rng.integers(1, 1400, rng.integers(1, 8))]
        got = packing.pack(sizes)
        for b, length in enumerate(got[2]):
            assert sum(s for s, x in zip(sizes, got[0], strict=True) if x == b) <= length
        fit = [[min(c for c in packing.LENGTHS if c >= sum(p)) for p in parts] for parts in partitions(sizes) if all(sum(p) <= max(packing.LENGTHS) for p in parts)]
        ratios.append(cost(got[2]) / min(map(cost, fit)))
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.03 and max(ratios) < 1.35, (np.mean(ratios), max(ratios))


def test_equal_shards_have_bins_of_their_own(spark):
    df = spark.createDataFrame([(i, "w " * (300 + i)) for i in range(50)], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(df.unionByName(df).unionByName(df.repartition(1)), shard_pieces=50).toPandas()
    bins = got.groupby("bin_id").agg(used=("length", "sum"), most=("bin_length", "first"))
    assert (bins.used <= bins.most).all() and got.length.sum() == 3 * sum(300 + i for i in range(50))


def test_language(spark):
    words = {"en": "the and of with this that from", "de": "der und die nicht eine sich auch", "fr": "le et les une dans pour avec"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[lang].split(), rng.integers(3, 60))), lang) for i, lang in enumerate(["en", "de", "fr"] * 100)]
    odd = [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "und die nicht " * 20_000, None), (904, "中文", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(df, ~langid.held_out(), train_rows=60)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(got) == len(rows) + len(odd) and len(held) > 30
    assert np.mean([got[i]["_lang_pred"] == lang for i, _, lang in held]) > 0.97
    assert [got[i]["_lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r["_score"] <= 1 for r in got.values())
    assert {r["_lang_pred"] for r in langid.identify(df.limit(3), langid.train(df.limit(0), F.lit(True))).collect()} == {"und"}


def grams_of(text):
    letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    return {tuple(letters[i : i + n]) for n in (1, 2, 3) for i in range(len(letters) - n + 1)}


def test_language_model_is_the_kernel_ridge_solution():
    """The weights give what the kernel, its landmarks and the ridge equations give, worked out from sets of n-grams."""
    rng = np.random.default_rng(9)
    words = {"en": "the and of with this", "de": "der und die nicht eine", "ru": "и в не на что"}
    data = [(" ".join(rng.choice(words[k].split(), rng.integers(2, 12))), k) for k in ["en", "de", "ru"] * 12]
    texts, labels = [t for t, _ in data], [k for _, k in data]
    model = langid.fit(texts, labels, per_lang=5, ridge=0.01)
    sets = [grams_of(t) for t in texts]
    marks = [sets[i] for lang in model.langs for i in [i for i, x in enumerate(labels) if x == lang][:5]]
    known = set().union(*marks)
    kernel = lambda a, b: len(a & b & known) / np.sqrt(len(a & known) * len(b & known))
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(k)
    good = value > 1e-6 * value.max()
    feature = lambda s: np.array([kernel(s, m) for m in marks]) @ (vector[:, good] / np.sqrt(value[good]))
    x = np.array([feature(s) for s in sets])
    centre, y = x.mean(axis=0), np.where(np.array(labels)[:, None] == np.array(model.langs), 1.0, -1.0)
    a = (x - centre) / np.sqrt(12)
    coef = np.linalg.solve(a.T @ a + 0.01 * np.eye(a.shape[1]), a.T @ (y / np.sqrt(12)))
    asked = ["the und", "не", "nicht this der", texts[3]]
    symbols, slots = langid._symbols(model.letters, model.scripts), langid._slots(model.grams)
    got = langid._normal(langid._presence(asked, symbols, slots, len(model.grams))) @ model.weights + model.bias
    assert np.allclose(got, [(feature(grams_of(t)) - centre) @ coef for t in asked], atol=1e-4)


def test_languages_with_odd_rows_are_learned(spark):
    """One id for all rows, null ids, repeated rows, only very long texts; and rare scripts stay apart."""
    rows = [(7, f"der und die nicht {i}x", "de") for i in range(60)] + [(None, f"the and of {i}q", "en") for i in range(60)] + [(i, "le et les une dans", "fr") for i in range(40)]
    rows += [(1000 + i, "ja nee het een " * 3000, "nl") for i in range(3)]
    cjk, kana = ["".join(chr(0x4E00 + (i * 37 + j * 11) % 900) for j in range(40)) for i in range(30)], ["".join(chr(0xAC00 + (i * 41 + j * 13) % 900) for j in range(40)) for i in range(30)]
    rows += [(2000 + i, t, "zh") for i, t in enumerate(cjk)] + [(3000 + i, t, "ko") for i, t in enumerate(kana)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS _score", "2 AS _lang_pred", "3 AS `a.b`")
    model = langid.train(df, F.lit(True), train_rows=20)
    assert model.langs == ["de", "en", "fr", "ko", "nl", "zh"]
    got = langid.identify(df, model, lang_name="found", score_name="sure").filter("lang <> found OR `a.b` <> 3").count()
    assert got == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_language_held_out(spark):
    root = DATA.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang")
    got = langid.op6_langid(spark, root).filter("held_out").join(truth, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 16)).astype(np.float32)
    centre = rng.standard_normal(16)
    crowd = (centre + 0.05 * rng.standard_normal((90, 16))).astype(np.float32)
    pairs = x[:20] + 0.03 * rng.standard_normal((20, 16)).astype(np.float32)
    every = np.concatenate([x, crowd, pairs, x[5:6], x[5:6] * 2])
    label = [i % 2 for i in range(len(x))] + [1] * len(crowd) + [i % 2 for i in range(20)] + [1, 1]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(every, label, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, every[5].tolist(), None), (905, [1.0], 1), (906, [2.0], 1), (None, every[5].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in nndescent.embedding_groups(df).collect()}
    u = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(every))] == near.sum(1).tolist()
    reach = list(range(len(every)))
    for _ in range(4):
        for i in range(len(every)):
            for j in np.flatnonzero(near[i]):
                reach[i] = reach[j] = min(reach[i], reach[j])
    assert [got[i].component_id for i in range(len(every))] == reach
    assert all(got[i].kept == (reach[i] == i) for i in range(len(every)))
    assert [(got[i].n_links, got[i].component_id) for i in (900, 901, 902, 903, 904, 905, 906, None)] == [(0, 900), (0, 901), (0, 902), (0, 903), (0, 904), (1, 905), (1, 905), (0, None)]
    assert nndescent.embedding_groups(df.limit(0)).count() == 0


def brute_groups(vectors, labels):
    """Links and least reachable row of each vector, by comparing all with all."""
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    reach, last = np.arange(len(u)), None
    while last is None or (reach != last).any():
        last = reach
        reach = np.minimum(reach, np.where(near, reach[None, :], len(u)).min(axis=1))
    return near.sum(axis=1).tolist(), reach.tolist()


@pytest.mark.parametrize("rounds", [5, 0])
def test_crowds_beside_crowds(spark, rounds):
    """Families larger than any list that link across, doubles, and no round at all, after which everything is compared exactly."""
    rng = np.random.default_rng(8)
    centre, side = rng.standard_normal(24), rng.standard_normal(24)
    side -= centre * (side @ centre) / (centre @ centre)
    side *= np.linalg.norm(centre) / np.linalg.norm(side)
    families = [centre + t * side + 0.01 * rng.standard_normal((60, 24)) for t in (0, 0.35)]
    every = np.concatenate([*families, rng.standard_normal((100, 24))])
    labels = np.array([0] * 120 + [0, 1] * 50)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(every, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in nndescent.embedding_groups(df, rounds=rounds).collect()}
    n_links, reach = brute_groups(every, labels)
    assert 100 < max(n_links) and [got[i].n_links for i in range(len(every))] == n_links and [got[i].component_id for i in range(len(every))] == reach


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_embedding_query_against_all_pairs(spark):
    root = DATA.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{root}/embeddings.parquet").orderBy("vec_id").toPandas()
    got = {r.vec_id: r for r in nndescent.op5_embedding_dedup(spark, root).collect()}
    good = rows[rows.label.notna() & rows.embedding.map(lambda v: v is not None and np.isfinite(np.array(v, dtype=float)).all() and np.any(v))].reset_index(drop=True)
    n_links, reach = brute_groups(np.stack(good.embedding.map(lambda v: np.array(v, dtype=np.float64))), good.label.to_numpy())
    ids = good.vec_id.tolist()
    assert [got[i].n_links for i in ids] == n_links and [got[i].component_id for i in ids] == [ids[k] for k in reach]
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def read_by_the_rules(raw):
    """The record ids of an archive, read member by member by what the format demands of records."""
    keys = set()
    while raw:
        unzip = zlib.decompressobj(31)
        text, raw = unzip.decompress(raw) + unzip.flush(), unzip.unused_data
        head, body = text.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines)}
        assert version == "WARC/1.1" and fields["warc-type"] in ("response", "revisit")
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"]) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"])
        assert body[int(fields["content-length"]) :] == b"\r\n\r\n" and ("warc-profile" in fields) == (fields["warc-type"] == "revisit")
        assert fields["warc-record-id"] not in keys
        keys.add(fields["warc-record-id"])
    return keys


def test_archives(spark):
    big, small = "é" * 700, "tiny"
    rows = [(1, "u1", big), (2, "u2\r\n", big), (3, "u3", small), (4, "u4", small), (5, None, None), (6, "u6", "x" * 200_000), (6, "u6", "x" * 200_000), (None, "n", big)] + [(10 + i, "v", f"<p>\r\n\r\nContent-Length: {i}</p>" * 90) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS first").repartition(3)
    folder = common.scratch(spark, "warc")
    index = warc.archive_pages(pages, folder, archive_bytes=60_000)
    got = sorted(warc.read_archives(index, f"{folder}/warc").collect(), key=lambda r: (r.page_id or 0))
    assert len(got) == len(rows) and index.select("archive").distinct().count() > 1
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type, by[2].refers_to) == ("revisit", 2, "response", None)
    assert by[3].record_type == by[4].record_type == "response" and by[6].record_type == "response" and by[None].refers_to == 2
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    # with many groups of equal payloads, kinds come by another join
    rows_of = pages.selectExpr("page_id", "url", "CAST(coalesce(html, '') AS BINARY) payload")
    one, other = (sorted(map(repr, warc.record_kinds(rows_of, broadcast_rows=n).collect())) for n in (50_000, 0))
    assert one == other
    # every archive is a chain of gzip members at the offsets of the index
    path, keys = f"{folder}/warc".removeprefix("file://"), set()
    for name in {r.archive for r in index.collect()}:
        parts = sorted((r.offset, r.length) for r in index.filter(F.col("archive") == name).collect())
        keys |= read_by_the_rules(open(f"{path}/{name}", "rb").read())
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) == os.path.getsize(f"{path}/{name}")
    assert len(keys) == len(rows)
    assert warc.read_archives(warc.archive_pages(pages.limit(0), common.scratch(spark, "warc")), folder).count() == 0


def test_damaged_archives_are_noticed():
    raw = warc.record(uuid.UUID(int=1), "2024-01-01T00:00:00Z", 1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), "response", None)
    assert warc.parse(raw)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r", b"paylord\r"))
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[:-5]])))
    assert list(warc.records(iter([raw[:10], raw[10:] + raw]))) == [raw, raw]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.save(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= before.count()
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "mix":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect())
        if name == "near_dedup":
            folded = [" ".join(r.text.lower().split()) for r in docs.collect()]
            assert len(set(folded)) == len(folded)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_packed_order_keeps_to_the_weights(spark):
    """Documents in several files in order of their sources: prefixes of the packed output still hold each source's share."""
    sizes = {"a": 1600, "b": 400, None: 100}
    rows = [(i, " ".join(["word"] * 400), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = common.save(spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(5, "doc_id"), "test-order")
    got = corpus_pipeline.pack(spark, docs, DATA, shard_pieces=64).toPandas()
    assert sorted(got.doc_id) == list(range(len(rows)))
    assert (got.groupby("bin_id")[["shard_place", "bin_place"]].nunique() == 1).all(axis=None)
    of = got.sort_values(["shard_place", "bin_place", "bin_offset"]).doc_id.map(lambda i: rows[i][2] or "none").to_numpy()
    # weights are square roots of sizes: 4, 2 and 1; with less than a block (8 documents) and a shard of 64 of deviation
    n = np.arange(1, 601)
    for source, share in (("a", 4 / 7), ("b", 2 / 7), ("none", 1 / 7)):
        assert np.abs(np.cumsum(of == source)[:600] - n * share).max() < 8 + 64
    assert (of[:600] == "none").sum() > 0 and (of[:600] == "b").sum() > 100


@pytest.mark.parametrize(("n", "dims", "at"), [(20_000, 64, 0.94)])
def test_sparse_links_in_a_large_label_are_found(spark, n, dims, at):
    """One label of vectors that have nothing to do with one another, and forty pairs near the threshold."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(40):
        across = rng.standard_normal(dims)
        across -= across @ x[i] * x[i]
        x[n - 1 - i] = at * x[i] + math.sqrt(1 - at * at) * across / np.linalg.norm(across)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.embedding_groups(rows).filter("n_links > 0").collect()}
    found = sum((n - 1 - i) in got and got[n - 1 - i] == (1, i) for i in range(40))
    assert set(got) <= {*range(40), *range(n - 40, n)} and found >= 38


def test_a_sample_without_links_measures_nothing(spark):
    rows = spark.createDataFrame([(i, np.eye(64)[i].tolist(), 1) for i in range(64)], "id long, vec array<double>, label int")
    nodes = common.save(nndescent.fold(rows), "nodes")
    graph, recall = nndescent.neighbour_graph(nodes)
    assert recall is None and graph.filter("sim >= 0.93").count() == 0
    assert nndescent.seed_orders(nodes, 0.93) == nndescent.SEED_ORDERS and nndescent.seed_orders(nodes, 0.93, block=4) > nndescent.SEED_ORDERS
