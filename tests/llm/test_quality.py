import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm._text import Splitter
from quarry.llm.queries import held_out, op6_quality, quality_machine
from quarry.llm.quality import Machine, score, train

SF = "/root/testdata/sf0.1"


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    machine = Machine(0.3, rng.normal(size=quality.N_FEATURES), rng.normal(0, 0.3, (quality.N_FEATURES, 4)))
    texts = ["a b a c D!", "", "x" * 30, "The cat.\nThe cat. 12 $$ é", " ", "w " * 3000]
    (words,) = Splitter(fold=True).chunks(pa.array(texts))
    got = machine.score(words)
    feature, off, binned = quality._features(words)
    for i in range(len(texts)):
        x = np.zeros(quality.N_FEATURES)
        np.add.at(x, feature[off[i] : off[i + 1]], 1 / max(1, off[i + 1] - off[i]))
        np.add.at(x, binned[i], quality.STAT_VALUE)
        at = np.flatnonzero(x)
        z = machine.bias + machine.w[at] @ x[at]
        z += sum(machine.v[a] @ machine.v[b] * x[a] * x[b] for k, a in enumerate(at) for b in at[k + 1 :])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = op6_quality(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    right = (rows.predicted == rows.quality).mean()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean()
    print(len(rows), right, auc, (good >= 0.7).mean(), (bad >= 0.7).mean())
    assert auc > 0.99 and right > 0.97 and (good >= 0.7).mean() > 0.99


def test_learns_only_from_its_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lied = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (train(docs, x.where(~held_out()), max_train=300, epochs=2) for x in (labels, lied))
    assert np.array_equal(a.w, b.w) and a.bias == b.bias


def test_odd_inputs(spark):
    rows = [(1, None, 0.1, "x"), (1, "", 0.1, "x"), (None, "good words here", None, None), (2, "?!" * 50, 0.2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    machine = train(docs, none)
    assert [r.score for r in score(docs, machine).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    got = score(docs, train(docs, labels, epochs=2)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert got[0].score == got[1].score
    assert score(docs.limit(0), machine).collect() == []
