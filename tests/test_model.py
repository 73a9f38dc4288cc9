"""Training, scoring, elimination and the whole preparation on small frames."""

import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wayfold.operators.calendar import us_holidays
from wayfold.plans import conversion, model

FAST = model.TreeSettings(depth=3, rounds=3, rate=0.3, row_sample=1.0, column_sample=1.0)


@pytest.fixture(scope="module")
def rows_of(spark):
    """A label that depends on ``good`` and, weakly, on ``kind``."""
    rng = random.Random(9)
    data = []
    for i in range(600):
        good, kind = rng.random(), rng.choice("abc")
        won = int(good + (0.2 if kind == "a" else 0.0) > 0.6)
        known = None if rng.random() < 0.1 else good
        data.append((f"id{i}", i % 12, f"c{i % 3}", f"m{i % 2}", date(2024, 1, 1) + timedelta(i % 90), won,
                     known, good * 2 + 1 if i % 3 else None, rng.random(), kind if rng.random() < 0.9 else None,
                     "YN"[i % 2], "ABCJ"[i % 4], f"{i % 9 + 1}{'ABCD'[i % 4]}", 10.0 * i if won else None,
                     1.0 if i % 2 else None))
    return spark.createDataFrame(
        data,
        "key string, zip int, state string, market string, day date, won int, good double, twin double, noise double, "
        "kind string, vacant string, size string, code string, amount double, rare double",
    ).repartition(3)


def test_scores_separate_the_classes(rows_of):
    fitted = model.train_gbt(rows_of, ["good", "noise"], ["kind"], "won", FAST)
    scored = model.with_probability(fitted, rows_of)
    assert model.metrics(scored, "won", "all").first()["auc"] > 0.9
    weight = model.importances(fitted)
    assert max(weight, key=weight.get) == "good" and set(weight) == {"good", "noise", "kind"}
    table = model.feature_importance(fitted, rows_of, ["good", "noise"], "won").collect()
    assert table[0]["feature"] == "good" and table[0]["color"] == "green"
    assert {r["feature"]: r["color"] for r in table}["kind"] == "lightblue"


def test_batch_score_keeps_the_range(rows_of):
    fitted = model.train_gbt(rows_of, ["good"], [], "won", FAST)
    first, last = date(2024, 1, 10), date(2024, 1, 20)
    out = model.score_batch(fitted, rows_of, ["key", "zip"], "day", first, last)
    assert out.columns == ["key", "zip", "pred_prob"]
    assert out.count() == rows_of.where(F.col("day").between(first, last)).count()


def test_elimination_drops_noise_first(rows_of, spark):
    wide = rows_of.withColumns({f"n{i}": F.rand(i) for i in range(3)})
    ranks = model.rfe_rank(wide, ["good", "noise", "n0", "n1", "n2"], "won", FAST, keep=1, step=2)
    assert ranks["good"] == 1 and sorted(ranks.values()) == [1, 2, 2, 3, 3]
    sweep = model.rfe_sweep(rows_of, rows_of, {"good": 1, "noise": 2}, "won", FAST).collect()
    assert [(r["cutoff"], r["n_features"], r["part"]) for r in sweep] == [
        (1, 1, "train"), (1, 1, "test"), (2, 2, "train"), (2, 2, "test"),
    ]


COLUMNS = conversion.ConversionColumns(
    key="key", label="won", zip="zip", day="day", amount="amount", market="market", levels=("zip", "state", "market"),
    yes_no=("vacant",), unit_sizes=("size",), score_code="code", zip_medians=("good",), one_hot=("kind",),
    median_fill=("good", "twin", "size", "disposable_part", "rare"), mode_fill=("ability_part",), ignore=("code", "avg_zip_amount"),
)


@pytest.mark.parametrize("use_all_rows", [False, True])
def test_preparation(rows_of, spark, use_all_rows):
    ready = conversion.prepare(
        rows_of, COLUMNS, us_holidays(spark, 2024, 2024), use_all_rows=use_all_rows, target_threshold=0.0, mutual=0.6
    )
    for frame in (ready.train, ready.test, ready.validation):
        for c in (*COLUMNS.median_fill, *COLUMNS.mode_fill):
            if c in frame.columns:
                assert frame.where(F.col(c).isNull()).count() == 0, c
    assert "rare" not in ready.train.columns
    keys = lambda df: {r[0] for r in df.select("key").collect()}
    train, test, rest = keys(ready.train), keys(ready.test), keys(ready.validation)
    assert not train & test
    assert bool((train | test) & rest) == use_all_rows
    # "twin" repeats "good" wherever it is known: only one is kept.
    assert len({"good", "twin"} & set(ready.numeric)) == 1
    assert set(ready.tables) == {"fill", "zips", "bounds"}
    fitted = model.train_gbt(ready.train, ready.numeric, ready.categorical, "won", FAST)
    assert model.metrics(model.with_probability(fitted, ready.validation), "won", "v").first()["auc"] > 0.8


def test_prepared_rows_are_stored_once(rows_of, spark, monkeypatch):
    """Test and validation rows are stored whole when filled from the zip table, scored ones with what the model reads."""
    from wayfold.plans import scoring

    stored, cut = [], conversion.cut
    monkeypatch.setattr(conversion, "cut", lambda df, label="cut": stored.append((label, df.columns, df.count())) or cut(df, label))
    ready = conversion.prepare(rows_of, COLUMNS, us_holidays(spark, 2024, 2024), target_threshold=0.0, mutual=0.6)
    whole = [(set(columns) - {"__all"}, n) for label, columns, n in stored if label == "zipfill"]
    assert whole == [(set(x.columns), x.count()) for x in (ready.test, ready.validation)]
    assert not {"test", "validation"} & {label for label, *_ in stored}
    fitted = model.train_gbt(ready.train, ["good"], ["ability_part"], "won", FAST)
    stored.clear()
    first, last = date(2024, 1, 10), date(2024, 1, 20)
    scored = scoring.score_fitted(rows_of, COLUMNS, ready.fit, ready.tables, fitted, ["key", "zip"], first, last)
    assert scored.count() == rows_of.where(F.col("day").between(first, last)).count()
    assert [columns for *_, columns, _ in stored] == [["key", "zip", "market", "good", "ability_part", "__all"]]


def test_columns_that_no_step_reads_are_not_stored(rows_of, spark, monkeypatch):
    """Ignored columns go before the rows are stored; amount and state, once the features are filled."""
    stored, cut = {}, conversion.cut
    monkeypatch.setattr(conversion, "cut", lambda df, label="cut": stored.setdefault(label, df.columns) and cut(df, label))
    wide = rows_of.withColumn("unread", F.lit(1))
    chosen = replace(COLUMNS, ignore=(*COLUMNS.ignore, "unread"))
    ready = conversion.prepare(wide, chosen, us_holidays(spark, 2024, 2024), target_threshold=0.0, mutual=0.6)
    assert {"amount", "state", "__split"} <= set(stored["balanced"]) and not {"code", "unread"} & set(stored["balanced"])
    gone = {"amount", "state", "code", "unread", "avg_zip_amount", "__split"}
    for frame in (ready.train, ready.test, ready.validation):
        assert not gone & set(frame.columns) and {"key", "won", "zip", "day", "market", *ready.numeric, *ready.categorical} <= set(frame.columns)
    assert stored["imputed"] == ready.train.columns


def test_marked_rows_are_not_hashed_again(rows_of, spark, rows, monkeypatch):
    """Marks stored with the rows give the same frames as their hashes; the split and the sample then compute none."""
    from wayfold.storage import cut

    # Keys repeat and are missing.
    odd = rows_of.withColumn("key", F.when(F.col("noise") > 0.05, F.substring("key", 1, 4)))
    made = []
    for frame in (cut(odd), cut(conversion.marked(odd, COLUMNS))):
        plans, write = {}, conversion.cut
        with monkeypatch.context() as m:
            m.setattr(conversion, "cut", lambda df, label="cut", p=plans, w=write: p.setdefault(label, []).append(df) or w(df, label))
            made.append((conversion.prepare(frame, COLUMNS, us_holidays(spark, 2024, 2024), 1.0, False, 0.0, 0.6), plans))
    (plain, hashed), (marked, plans) = made
    for name in ("train", "test", "validation"):
        one, other = getattr(plain, name), getattr(marked, name)
        assert one.columns == other.columns and rows(one) == rows(other) and not one.isEmpty()
    assert (plain.numeric, plain.categorical, plain.fit.levels) == (marked.numeric, marked.categorical, marked.fit.levels)
    assert {t: rows(x) for t, x in plain.tables.items()} == {t: rows(x) for t, x in marked.tables.items()}
    # Validation rows are stored last.
    assert ["md5" in p["zipfill"][-1]._jdf.queryExecution().optimizedPlan().toString() for p in (hashed, plans)] == [True, False]
    assert conversion.WORKING not in plans["balanced"][0].columns


def test_score_batch_stores_marks(spark):
    from __spark_entry__ import SMALL
    from wayfold.catalog import modelling
    from wayfold.catalog.proxies import Inputs

    stored = modelling._read_rows(Inputs(spark, SMALL))
    assert {conversion.WORKING, conversion.BALANCE} <= set(stored.columns)
    train = stored.where(modelling.TRAIN).select("opportunityid")
    assert train.exceptAll(stored.where(conversion.WORKING).select("opportunityid")).isEmpty()
    assert train.count() == stored.where(conversion.WORKING).count()


def test_default_settings():
    main, second = model.TreeSettings(), model.ELIMINATION
    assert (main.depth, main.rounds, main.rate, main.row_sample, main.column_sample, main.min_rows) == (
        7, 1000, 0.02, 0.6, 0.6, 2,
    )
    assert (second.depth, second.rounds, second.rate, second.min_rows) == (10, 200, 0.04, 10)


def test_many_levels_train(spark):
    """A category with more levels than the setting has bins."""
    df = spark.createDataFrame([(f"c{k % 70}", float(k), k % 2) for k in range(280)], "c string, v double, y int")
    settings = model.TreeSettings(depth=2, rounds=1, rate=0.3, row_sample=1.0, column_sample=1.0)
    fitted = model.train_gbt(df, ["v"], ["c"], "y", settings)
    assert model.with_probability(fitted, df).where("pred_prob BETWEEN 0 AND 1").count() == 280


@pytest.mark.parametrize("name", ["train_gbt", "score_batch", "save_load_model", "feature_importance", "conversion_train_eval", "rfe_rank", "rfe_sweep"])
def test_queries_train_with_the_documented_settings(spark, monkeypatch, name):
    from __spark_entry__ import SMALL, queries

    class Stop(Exception):
        pass

    def stop(*args, **named):
        raise Stop([x for x in (*args, *named.values()) if isinstance(x, model.TreeSettings)])

    monkeypatch.setattr(model, "train_gbt", stop)
    monkeypatch.setattr(model, "rfe_rank", stop)
    with pytest.raises(Stop) as told:
        queries()[name](spark, SMALL)
    assert told.value.args[0] == [model.ELIMINATION if name.startswith("rfe") else model.TreeSettings()]


def test_training_rows_are_dealt_to_more_tasks_where_there_are_many(spark, monkeypatch):
    from __spark_entry__ import SMALL
    from wayfold.catalog import modelling
    from wayfold.catalog.proxies import Inputs

    inputs, cores = Inputs(spark, SMALL), spark.sparkContext.defaultParallelism
    n = inputs.lineitem.count()
    few = modelling._training_rows(inputs)
    assert few.count() == n and len(few.inputFiles()) == cores
    monkeypatch.setattr(modelling, "TASK_ROWS", n // (3 * cores))
    many = modelling._training_rows(inputs)
    assert many.count() == n and len(many.inputFiles()) >= 3 * cores


def test_fitted_tables_join_their_rows_once(spark, monkeypatch):
    from __spark_entry__ import SMALL, queries
    from wayfold.catalog.proxies import Inputs

    asked, stored = [], Inputs.stored
    monkeypatch.setattr(Inputs, "stored", lambda self, name, *columns: asked.append((name, *columns)) or stored(self, name, *columns))
    found = queries()["load_fitted_tables"](spark, SMALL)
    assert asked == [("conversion", "zip", "balance", "home_value")]
    assert {r["kind"] for r in found.collect()} == {"zip", "bounds"}


@pytest.mark.parametrize("name", ["train_gbt", "conversion_train_eval", "feature_importance", "rfe_rank", "rfe_sweep"])
def test_queries_fit_all_their_rows(spark, monkeypatch, name):
    """No fit of a query leaves rows out, however many there are for its parts."""
    from __spark_entry__ import SMALL, queries

    class Stop(Exception):
        pass

    seen, fit = [], model.fit_models

    def few(df, models, label, settings):
        fitted = fit(df, models, label, model.TreeSettings(depth=2, rounds=2), part_rows=64)
        seen.append((df.where(f"{label} IS NOT NULL").count(), [m.table.agg(F.sum("rows")).first()[0] for m in fitted]))
        if len(seen) == (4 if name == "rfe_sweep" else 3 if name == "rfe_rank" else 1):
            raise Stop
        return fitted

    monkeypatch.setattr(model, "fit_models", few)
    with pytest.raises(Stop):
        queries()[name](spark, SMALL)
    assert all(rows > 8 * 64 and found == [rows] * len(found) for rows, found in seen)


@pytest.mark.parametrize(
    ("name", "others"), [("train_gbt", set()), ("save_load_model", {"opportunityid"}), ("feature_importance", set()), ("rfe_rank", set()), ("rfe_sweep", {"working"})]
)
def test_training_rows_are_stored_once_with_the_columns_read(spark, monkeypatch, name, others):
    from __spark_entry__ import SMALL, queries
    from wayfold.catalog import modelling

    class Stop(Exception):
        pass

    def stop(df, *args, **named):
        raise Stop

    stored, cut = {}, modelling.cut
    monkeypatch.setattr(modelling, "FEW_ROWS", 0)
    monkeypatch.setattr(modelling, "cut", lambda df, label="cut", **named: stored.setdefault(label, cut(df, label, **named)))
    monkeypatch.setattr(model, "train_gbt", stop)
    with pytest.raises(Stop):
        queries()[name](spark, SMALL)
    read = modelling.CANDIDATES if name.startswith("rfe") else [*modelling.NUMERIC, *modelling.CATEGORICAL]
    assert list(stored) == ["joined", "training"] and set(stored["training"].columns) == {*read, "won", *others}
    if name == "rfe_sweep":
        from wayfold.catalog.proxies import Inputs
        from wayfold.operators import sampling

        rows = Inputs(spark, SMALL).conversion.select("opportunityid")
        parts = sampling.split_fraction(stored["training"], "opportunityid", 0.8, "2", "working")
        assert [x.count() for x in parts] == [x.count() for x in sampling.split_fraction(rows, "opportunityid", 0.8, "2")]


def test_scored_rows_are_not_stored(spark, monkeypatch):
    """A row for every score is stored, and its counts tell the number of rows and whether scores are probabilities."""
    from wayfold.catalog import modelling

    labels, cut = [], modelling.metrics.cut
    monkeypatch.setattr(modelling.metrics, "cut", lambda df, label="cut", **named: labels.append(label) or cut(df, label, **named))
    scored = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.2), (None, 0.3)], "won int, pred_prob double")
    assert modelling._invariants(scored, "p").first().asDict() == {"part": "p", "auc_above_half": True, "n_rows": 4, "in_range": True}
    wrong = scored.union(spark.createDataFrame([(1, 1.5), (1, None)], scored.schema))
    assert modelling._invariants(wrong, "p").first().asDict() == {"part": "p", "auc_above_half": True, "n_rows": 6, "in_range": False}
    none = modelling._invariants(scored.where("false"), "p").first()
    assert (none["n_rows"], none["in_range"]) == (0, None)
    assert set(labels) <= {"score-counts"}


def test_long_tables_leave_no_shuffle_files(spark):
    import time

    from wayfold.storage import cut, drop

    folders = [f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in [d]]

    def shuffled():
        from pathlib import Path

        return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}

    rows = spark.range(100_000).selectExpr("id % 1000 AS k", "id").repartition(3, "k")
    before = shuffled()
    stored = cut(rows, tidy=True)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and stored.count() == 100_000
    assert all(".zstd." in f for f in stored.inputFiles())
    drop(stored)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(stored.inputFiles()[0])
