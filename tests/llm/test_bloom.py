import numpy as np
import pytest
from pyspark.sql import functions as F

from timelode.llm.bloom import bloom, might_hold


def hashes(spark, n, tasks):
    return spark.range(0, n, 1, tasks).select(F.xxhash64("id").alias("key"))


def test_rows_of_the_filter_follow_the_keys_not_the_tasks(spark, monkeypatch):
    """As many rows are made for keys in 64 tasks as for those in one, and five times as many for five times the keys."""
    made, kind = [], type(spark.range(1))
    plain = kind.mapInArrow

    def counted(self, *args, **kwargs):
        made.append(plain(self, *args, **kwargs))
        return made[-1]

    monkeypatch.setattr(kind, "mapInArrow", counted)
    few, many, more = [(bloom(hashes(spark, n, tasks), n), made[-1].count())[1] for n, tasks in ((20_000, 1), (20_000, 64), (100_000, 64))]
    assert few == many and 4.5 * few < more < 5.5 * few


@pytest.mark.parametrize("n", [0, 1, 513, 40_000])
def test_the_filter_holds_its_keys_and_few_others(spark, n):
    told = bloom(hashes(spark, n, 7), n).value
    keys, others = (np.array([r.key for r in hashes(spark, m, 1).collect()], np.int64) for m in (n, 60_000))
    assert might_hold(told, keys).all() and might_hold(told, others[n:]).mean() < 0.005
    assert len(told) == 1024 * max(1, -(-n // 512))
