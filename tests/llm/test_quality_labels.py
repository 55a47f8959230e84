"""Few, one-class and foreign labels decide nothing; trees score like a plain walk over their nodes."""

import numpy as np
import pyarrow as pa
import pytest

from waveloom.llm import gbdt, quality

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(i, 40 + i % 20) if i % 3 else "### %% " * 20 + prose(i, 30) for i in range(120)] + ["too short", None, ""]
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, quality string, copy int")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def base(docs):
    return {r.doc_id for r in docs.collect() if not quality.base_failed(quality.statistics(pa.array([r.text])))[0]}


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(i, int(i < 10), 0) for i in range(39)], [(i, 0, 0) for i in range(100)], [(i, 1, 0) for i in range(100)], [(10_000 + i, i % 2, 0) for i in range(500)]])
def test_labels_that_teach_nothing(spark, docs, rows):
    got = quality.score_quality(docs, quality.fit_quality(docs, labels(spark, rows))).collect()
    assert {r.doc_id for r in got if r.kept} == base(docs) and len(got) == 123


def test_foreign_labels_do_not_use_up_the_bound(spark, docs):
    own = [(i, int(i % 3 > 0), 0) for i in range(120)]
    alone = quality.fit_quality(docs, labels(spark, own), rows=120)
    among = quality.fit_quality(docs, labels(spark, own + [(10_000 + i, i % 2, 0) for i in range(3000)]), rows=120)
    assert not alone.constant and np.array_equal(alone.value, among.value)
    kept = {r.doc_id for r in quality.score_quality(docs, among).collect() if r.kept}
    assert kept == {i for i in base(docs) if i % 3}


def test_kept_equals_a_walk_over_the_nodes(spark, docs):
    m = quality.fit_quality(docs, labels(spark, [(i, int(i % 3 > 0), 0) for i in range(120)]))

    def walk(x):
        total = m.base
        for at in m.roots:
            while m.feature[at] >= 0:
                at = m.left[at] + (x[m.feature[at]] > m.cut[at])
            total += m.value[at]
        return total

    for r in quality.score_quality(docs, m).collect():
        text = docs.where(f"doc_id = {r.doc_id}").first().text if r.doc_id % 9 == 0 else None
        if text is not None:
            c = quality.statistics(pa.array([text]))
            assert r.kept == (not quality.base_failed(c)[0] and walk(quality.features(c)[0]) >= 0)


def test_few_rows_give_the_constant_model():
    x, y = np.random.default_rng(0).random((39, 2)), np.arange(39) % 2
    assert gbdt.fit(x, y, (0, 0)).constant and gbdt.fit(x, y * 0, (0, 0)).constant and not gbdt.fit(np.tile(x, (9, 1)), np.tile(x[:, 0] > 0.5, 9), (0, 0)).constant


def test_classes_that_no_statistic_tells_apart(spark):
    docs = spark.createDataFrame([(i, prose(1, 60), "x", 1) for i in range(60)] + [(60, "too short", "x", 1)], "doc_id long, text string, quality string, copy int")
    model = quality.fit_quality(docs, labels(spark, [(i, int(i < 10), 0) for i in range(60)]))
    assert len(model.roots) and model.constant  # sixty trees, none with a split
    assert {r.doc_id for r in quality.score_quality(docs, model).collect() if r.kept} == set(range(60)) == base(docs)
