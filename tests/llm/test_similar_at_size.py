"""What keeps the disk of near-duplicate groups in proportion to their texts: sketches, the sample, and shuffles that go."""

import time

import numpy as np

from timelode.llm import common, similar


def differ(a, b):
    return sum(int(x).bit_count() for x in (similar._sketch(a) ^ similar._sketch(b)).view(np.uint64))


def test_sketches_tell_long_texts_apart_and_lose_no_pair():
    rnd = np.random.default_rng(5)
    for n in (3, 40, 700, 4_000, 8_000):
        h = np.unique(rnd.integers(0, 2**64, 2 * n, dtype=np.uint64))
        rnd.shuffle(h)
        shared, one, other = h[: n - n // 9], h[n - n // 9 : n], h[n : n + n // 9]
        a, b = np.concatenate([shared, one]), np.concatenate([shared, other])
        assert 9 * differ(a, b) <= len(a) + len(b) or 10 * len(shared) < 8 * (len(a) + len(b) - len(shared))
        assert differ(a, b) <= len(one) + len(other)  # a bit needs a shingle that only one has
        assert 9 * differ(h[:n], h[n : 2 * n]) > 2 * n  # unrelated


def test_the_sample_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE_TEXTS", 10)
    rows = [(i, f"w{i} x{i} y{i}" + " a b c" * (i % 10 == 0)) for i in range(1_600)]
    keys, counts = similar.common_shingles(spark.createDataFrame(rows, "id long, text string").selectExpr("id", "cast(text as binary) AS text"), 3)
    shared = similar.shingle_hashes([b"a", b"b", b"c"], 3)[0]
    assert shared in keys and counts[keys == shared][0] >= 5  # held by 160 texts; a sample of ten or so would miss it


def test_shuffles_go_once_a_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, rows = shuffles(), spark.range(5_000).selectExpr("id % 977 AS k", "id")
    old = spark.conf.get(common.CLEANUP, None)
    held = rows.groupBy("k").count()
    held.collect()
    assert shuffles() - before  # of a query that is not written they stay while its result may be asked for
    before = shuffles()
    sums = common.save(rows.groupBy("k").sum("id"), "sums")
    assert spark.conf.get(common.CLEANUP, None) == old
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert sums.count() == held.count() == 977
