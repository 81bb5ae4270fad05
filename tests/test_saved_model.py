"""A saved churn model scores raw rows in another session; sparse one-hot rows keep every row."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from churnforge.operators import features as FE
from churnforge.operators import models as M
from churnforge.sources import fixtures


def test_saved_model_scores_raw_rows_in_a_new_session(spark, tmp_path):
    subs = fixtures.subscribers(spark, SF_SMALL)
    data = M.prepare_training(subs)
    model, _ = M.fit_model(data, M.model_specs(data.n_train)[0])
    M.ChurnModel(data.encoding, data.scaling, model).save(str(tmp_path / "churn"))
    want = {r.customerID: (r.Churn_Probability, r.Predicted_Churn) for r in M.predict(model, data.all_rows).collect()}
    other = spark.newSession()
    loaded = M.ChurnModel.load(str(tmp_path / "churn"))
    assert loaded.encoding.vocabulary == data.encoding.vocabulary and loaded.encoding.feature_columns == data.encoding.feature_columns
    raw = fixtures.subscribers(other, SF_SMALL)
    for rows, columns in ((raw, ["customerID", "Churn", "Churn_Probability", "Predicted_Churn"]),
                          (raw.drop("Churn"), ["customerID", "Churn_Probability", "Predicted_Churn"])):
        scored = loaded.score(rows)
        assert scored.columns == columns
        assert {r.customerID: (r.Churn_Probability, r.Predicted_Churn) for r in scored.collect()} == want
    one = loaded.score(raw.drop("Churn").limit(1)).collect()
    assert len(one) == 1 and (one[0].Churn_Probability, one[0].Predicted_Churn) == want[one[0].customerID]


def test_one_hot_sparse_keeps_rows_without_or_with_shared_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None), (1, "a"), (2, "new")], "id int, c string")
    vocabulary = FE.category_table(df.where(F.coalesce("c", F.lit("")) != "new"), ["c"])
    got = sorted(((r.id, r.indices) for r in FE.one_hot_sparse(df, vocabulary, "id", ["c"]).collect()), key=str)
    assert got == sorted([(1, [0]), (1, [1]), (None, [0]), (None, []), (1, [0]), (2, [])], key=str)
