"""Arms compared by their runs: facts that each arm found or missed, and the difference of two arms."""

from timelode.operators import knowledge

SCORES = "arm string, rep int, n_units long, n_procedures long, facts array<string>, n_facts int, n_noise long"


def test_arms_are_compared_by_fact_and_by_mean(spark):
    facts = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "label string")
    rows = [("a", 1, 4, 1, ["f1", "f2"], 2, 0), ("a", 2, 6, 2, ["f1"], 1, 3), ("b", 1, 5, 0, [], 0, 1), ("b", 2, None, None, None, None, None)]
    by_arm = {r.arm: r for r in knowledge.compare_arms(spark.createDataFrame(rows, SCORES), facts).collect()}
    a, b = by_arm["a"], by_arm["b"]
    assert (a.reps, a.mean_units, a.min_units, a.max_units, a.mean_noise) == (2, 5.0, 4, 6, 1.5) and (b.reps, b.mean_units, b.max_facts) == (1, 5.0, 0)
    assert [tuple(x) for x in a.recall] == [("f1", 2), ("f2", 1), ("f3", 0)] and [tuple(x) for x in b.recall] == [("f1", 0), ("f2", 0), ("f3", 0)]
    assert (a.delta, a.within_floor, b.delta, b.within_floor) == (1.5, True, -1.5, True)


def test_a_delta_is_of_two_arms(spark):
    rows = [(arm, 1, 1, 0, [f"f{i}" for i in range(n)], n, 0) for arm, n in (("a", 5), ("b", 1), ("c", 2))] + [("d", 1, None, None, None, None, None)]
    scores = spark.createDataFrame(rows, SCORES)
    found = knowledge.compare_arms(scores).collect()
    assert all(r.delta is None and r.within_floor is None for r in found) and {r.arm: r.reps for r in found} == {"a": 1, "b": 1, "c": 1, "d": 0}
    assert {r.arm: [x.fact for x in r.recall] for r in found}["c"] == ["f0", "f1"]
    assert {r.arm: (r.delta, r.within_floor) for r in knowledge.compare_arms(scores.filter("arm IN ('a', 'b')")).collect()} == {"a": (4.0, False), "b": (-4.0, False)}
    assert {r.arm: r.delta for r in knowledge.compare_arms(scores.filter("arm IN ('a', 'd')")).collect()} == {"a": None, "d": None}
