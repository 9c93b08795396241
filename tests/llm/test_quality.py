import random
import zlib

import numpy as np

from tests.llm.texts import SCHEMA, documents, frame, prose
from waymesh.llm import quality


def labelled(spark, count=400):
    """Prose, and prose with shouting or menus in it."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(count):
        text, good = prose(rng, rng.randrange(5, 300)), i % 3 > 0
        if not good:
            text = " | ".join(text.split()) if i % 2 else text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "k", 1, True, 2, "b", "r"))
        labels.append((i, int(good)))
    labels += [(5, None), (None, 1), (7, labels[7][1]), (10**6, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.na.drop().collect()}
    got = quality.score_documents(docs, labels).collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    held = [g for g in got if g.held_out]
    assert sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.95
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)


def test_held_out_labels_are_never_used(spark):
    docs, labels = labelled(spark, 120)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    one, two = (sorted((g.doc_id, g.score) for g in quality.score_documents(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_odd_rows_and_no_labels(spark):
    docs, labels = labelled(spark, 60)
    got = quality.score_documents(docs.unionByName(frame(spark)), labels).collect()
    assert len(got) == 60 + len(documents())
    none = labels.limit(0)
    assert {g.score for g in quality.score_documents(frame(spark), none).collect()} == {0.5}
    assert quality.keep_good(frame(spark), none).count() == len(documents())
    assert quality.score_documents(frame(spark, []), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    model = quality.AttentionModel.start(hidden=3, gates=2)
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(np.float64) * 0.5 + 0.01)
    x, begins, label = rng.random((7, quality.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p, _ = model.run(x, begins)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for n, g in model.gradients(x, begins, label).items():
        w = getattr(model, n)
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 5)]:
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            down = loss()
            w[at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_attention_weighs_every_passage():
    good, bad = "quiet river stone " * 40, "BUY NOW!! $$$ " * 60
    assert quality.passage_features(good + bad).shape[0] == -(-len(good + bad) // quality.PASSAGE)
    assert quality.passage_features("").shape == (1, quality.WIDTH) and not quality.passage_features("").any()
