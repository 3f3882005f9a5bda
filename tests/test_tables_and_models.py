import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import assemble as A, boosting, models as M
from pairlens.sources import pairs as S
from pairlens.staging import new_path
from tests.conftest import by_id


def test_pairs_csv_round_trip(spark, pairs):
    train, test = new_path(spark, "train"), new_path(spark, "test")
    S.write_pairs_csv(pairs.filter("split = 'train'"), train)
    S.write_pairs_csv(pairs.filter("split = 'test'"), test, labelled=False)
    got = by_id(S.load_pairs(spark, train, test))
    for row in pairs.collect():
        back = got[row.id]
        assert (back["question1"], back["question2"], back["split"]) == (row.question1, row.question2, row.split)
        assert back["is_duplicate"] == (row.is_duplicate if row.split == "train" else None)


def test_csv_quotes_and_missing_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text('1,2,3,"a ""quoted"", text","x, y",1\n4,5,6,,"two\nlines",0\n')
    got = by_id(S.read_pairs_csv(spark, str(tmp_path / "p.csv"), multi_line=True))
    assert got[1]["question1"] == 'a "quoted", text' and got[4]["question1"] == " " and got[4]["question2"] == "two\nlines"


def test_feature_table_predictions_and_vectors(spark, pairs):
    features = pairs.select("id", F.length("question1").alias("n"))
    path = new_path(spark, "features")
    S.write_feature_table(features, path)
    assert S.read_feature_table(spark, path, "n").columns == ["n"]
    path = new_path(spark, "scores")
    S.write_predictions(pairs.select("id", F.lit(0.5).alias("score")), path)
    back = spark.read.csv(path, header=True)
    assert back.columns == ["Id", "Score"] and back.count() == pairs.count()
    vectors = spark.createDataFrame([("a", [0.5, -1.25]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    path = new_path(spark, "vectors")
    S.write_word_vectors_text(vectors, path)
    assert {r.word: r.vec for r in S.read_word_vectors_text(spark, path).collect()} == {"a": [0.5, -1.25], "b": [3.0, 4.0]}


def test_sixty_six_features():
    assert len(A.FEATURES) == len(set(A.FEATURES)) == 66


def test_cleaning_scaling_and_audit(spark):
    df = spark.createDataFrame([(1, float("inf"), 2.0), (2, float("nan"), 2.0), (3, None, 2.0), (4, 3.0, 2.0)], "id long, a double, b double")
    assert [r.a for r in A.finite_or_zero(df).orderBy("id").collect()] == [0.0, 0.0, 0.0, 3.0]
    assert A.null_audit(df).first().asDict() == {"id": 0, "a": 1, "b": 0}
    scaled = A.standard_scale(A.finite_or_zero(df), ["a", "b"]).orderBy("id").collect()
    values = np.array([0, 0, 0, 3.0])
    assert [r.a for r in scaled] == pytest.approx(((values - values.mean()) / values.std()).tolist())
    assert [r.b for r in scaled] == [0.0] * 4


def test_split_is_stable_and_near_its_share(spark):
    ids = spark.range(5000)
    one = by_id(A.holdout_split(ids))
    assert one == by_id(A.holdout_split(ids.repartition(7)))
    assert 0.08 < sum(r["is_valid"] for r in one.values()) / 5000 < 0.125


def test_symmetric_augment(pairs):
    rows = A.symmetric_augment(pairs).filter("id = 1").orderBy("is_swapped").collect()
    assert (rows[0].question1, rows[0].question2) == (rows[1].question2, rows[1].question1)
    assert [r.weight for r in rows] == [1.0, 1.0] and rows[0].is_duplicate == rows[1].is_duplicate


def test_member_draws():
    draws = [M.member_params(i) for i in range(9)]
    assert [(d.eta, d.depth, d.subsample, d.column_share) for d in draws] == [
        (.025, 7, .5, 1), (.02, 7, .6, 1), (.01, 4, .6, .7), (.01, 6, .4, .7), (.015, 6, .4, .7),
        (.01, 5, .4, 1), (.015, 4, .6, 1), (.015, 4, .6, .7), (.01, 4, .7, .7)]


def test_metrics_and_blends(spark):
    df = spark.createDataFrame([(1, 1, 0.8, 0.2, 0.9), (2, 0, 0.5, None, 0.0)], "id long, is_duplicate int, a double, b double, s double")
    assert M.log_loss(df, score="a").first()[0] == pytest.approx(-(np.log(0.8) + np.log(0.5)) / 2)
    assert M.accuracy(df, score="a").first()[0] == 1.0
    got = by_id(M.blend_members(df.select("id", "a", "b"), df.select("id", F.col("s").alias("score"))))
    assert got[1]["score"] == pytest.approx((0.8 + 0.2 + 1.8) / 4) and got[2]["score"] == pytest.approx(0.5 / 3)
    best = by_id(df.select("id", M.blend_best_confidence([F.col("a"), F.col("b")]).alias("p")))
    assert best[1]["p"] == 0.8 and best[2]["p"] == 0.5     # the first of equals; missing scores are passed over


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.RandomState(0)
    rows = []
    for i in range(400):
        label = int(rng.rand() < 0.4)
        vec = rng.normal(size=3)
        other = vec + rng.normal(scale=0.2 if label else 2.0, size=3)
        rows.append((i, label, float(label + rng.normal(scale=0.7)), float(rng.rand()), vec.tolist(), other.tolist()))
    return spark.createDataFrame(rows, "id long, is_duplicate int, f1 double, f2 double, vec1 array<double>, vec2 array<double>")


@pytest.mark.parametrize("fit", [
    lambda d: M.random_forest(d, d, ["f1", "f2"], trees=10, depth=4),
    lambda d: M.embedding_pair_classifier(d, d, ["f1", "f2"], rounds=20),
    lambda d: M.blend_members(M.gbt_ensemble(d, d, ["f1", "f2"], rounds=8, members=2),
                              M.random_forest(d, d, ["f1", "f2"], trees=5, depth=3)),
])
def test_models_beat_the_base_rate(learnable, fit):
    scores = fit(learnable)
    joined = learnable.select("id", "is_duplicate").join(scores, "id")
    rows = joined.select("is_duplicate", "score").collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 for r in rows)
    share = np.mean([r.is_duplicate for r in rows])
    base = -(share * np.log(share) + (1 - share) * np.log(1 - share))
    assert M.log_loss(joined).first()[0] < base


@pytest.mark.parametrize("share", [0.001, 0.003, 0.1, 1.0])
def test_small_holdouts_have_their_share(spark, share):
    marked = A.holdout_split(spark.range(100_000), share=share).filter("is_valid").count()
    assert abs(marked - share * 100_000) <= 5 * (share * 100_000) ** 0.5 * (share < 1)


def test_default_sizes_are_those_of_the_source():
    assert inspect.signature(M.random_forest).parameters["trees"].default == 1000
    rounds = inspect.signature(M.gbt_ensemble).parameters["rounds"].default
    assert rounds == 2500 and boosting.best_round([1.0] * rounds, M.PATIENCE) == (1, True)


def test_malformed_pairs_are_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('"1","2","3","a","b","0"\n"x","2","3","a","b","0"\n')
    with pytest.raises(Exception):
        S.read_pairs_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_texts_of_several_lines(spark, tmp_path):
    text = 'one\ntwo\r\n\\n "three" \\\\'
    pairs = spark.createDataFrame([(1, 2, 3, text, "\\", 0)] * 50, S.PAIR_SCHEMA)
    S.write_pairs_csv(pairs.repartition(1), f"{tmp_path}/own")
    got = S.read_pairs_csv(spark, f"{tmp_path}/own").collect()
    assert len(got) == 50 and {(r.question1, r.question2) for r in got} == {(text, "\\")}
    (tmp_path / "other.csv").write_text('1,2,3,"a\nb ""c"" \\n",d,1\n')
    row = S.read_pairs_csv(spark, f"{tmp_path}/other.csv", multi_line=True).first()
    assert row.question1 == 'a\nb "c" \\n' and row.is_duplicate == 1
