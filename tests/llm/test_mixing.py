"""Mixing by curriculum: targets by the definition's loop, words taken, times and order."""

import random

import pytest

from wayfold.llm import mixing


def by_loop(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets as the rule states them: cap, share the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = left - sum(most * sizes[s] for s in full)
        goal = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return goal | {s: most * sizes[s] for s in full}
        full |= set(over)


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["a", "B", "é", None, "zz", "Z", "b"][: rng.randint(1, 7)]
    data = []
    for i in range(n):
        source = names[0] if rng.random() < 0.33 else rng.choice(names)
        data.append((i, " \t".join(["word"] * rng.choice([0, 1, 5, 40, 300])), source))
    return data + [(n, None, names[-1]), (n + 1, "", names[0]), (None, "a b\nc", names[0]), (n + 2, "one", names[0]), (n + 2, "one", names[0])]


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_words_taken(spark, seed):
    data = corpus(seed)
    frame = spark.createDataFrame([(i, t, s, "x") for i, t, s in data], "doc_id long, text string, source string, target string")
    got = mixing.mix(frame.repartition(3), cell_rows=16).collect()
    assert len(got) == len(data)
    sizes, taken = {}, {}
    for i, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goals = by_loop(sizes)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
    whole = {}
    kept = spark.createDataFrame([(i, s) for i, _, s in data], "doc_id long, source string")
    by_id = {(r["doc_id"], r["source"]): r for r in kept.collect()}
    source_of = {i: s for i, s in by_id}
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(goals[source], rel=1e-9)
        taken[source] = taken.get(source, 0) + r["taken"]
        whole[source] = int(r["target"])
    assert taken == whole


def test_small_and_large_cells_agree(spark, rows):
    frame = spark.createDataFrame(corpus(9), "doc_id long, text string, source string")
    assert rows(mixing.mix(frame, cell_rows=4)) == rows(mixing.mix(frame.repartition(5), cell_rows=1 << 20))


def test_times_follow_the_curves(spark):
    data = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), cell_rows=64)
    order = [r["position"] for r in mixing.in_training_order(mixed).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    halves = {}
    for r in mixed.select("source_size", "target", "position", "again", "taken", "doc_id").collect():
        for at in (r["position"], r["again"]):
            if at is not None:
                name = "abc"[r["doc_id"] % 3]
                early, late = halves.get(name, (0, 0))
                halves[name] = (early + (at < 0.5), late + (at >= 0.5))
    # Weight 1.5 to 0.5 asks for 5/8 of the words in the first half, the straight curve for a half.
    share = {s: a / (a + b) for s, (a, b) in halves.items()}
    assert share["a"] == pytest.approx(5 / 8, abs=0.01)
    assert share["b"] == pytest.approx(1 / 2, abs=0.01)
    assert share["c"] == pytest.approx(3 / 8, abs=0.01)


def test_the_mix_comes_in_the_order_of_training(spark):
    frame = spark.createDataFrame(corpus(3), "doc_id long, text string, source string").repartition(4)
    got = [r["position"] for r in mixing.mix(frame, cell_rows=16).collect()]
    known = [p for p in got if p is not None]
    assert len(known) > 100 and got == sorted(known) + [None] * (len(got) - len(known))


def test_empty_table_and_tables_without_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    got = mixing.mix(blank).collect()
    assert [r["taken"] for r in got] == [0, 0] and all(r["position"] is None for r in got)


def test_no_python_worker(spark):
    frame = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
