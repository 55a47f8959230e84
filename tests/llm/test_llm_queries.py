"""The numbered queries and the pipeline over the smallest tables, against SQL or brute force."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from waveloom.llm import registry
from waveloom.llm.shared import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_thirteen_and_the_pipeline():
    names = set(registry.queries()) | ({"pipeline"} & set(__spark_entry__.queries()))
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"} and len(names) == 14


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(tuple("None" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_stages_do_what_they_say(spark):
    docs = table(spark, DATA, "documents")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == cols, name
        if name != "source_mixing":
            assert out.join(docs, cols, "left_semi").count() == out.count() <= docs.count()
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.agg(F.sum("n_tokens")).first()[0] > docs.count()
    labels = table(spark, DATA, "labels")
    bad = table(spark, DATA, "documents").join(labels.where("quality = 0"), "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, table(spark, DATA, "documents"), DATA)
    assert kept.join(bad, "doc_id", "left_semi").count() <= 0.3 * max(1, bad.count())  # eleven of them among 150 labelled rows


def test_stages_keep_columns_of_any_name(spark):
    docs = table(spark, DATA, "documents").limit(150).withColumns({c: F.lit(c) for c in ("copy", "mix_key", "_k", "_h", "k", "node", "quality", "sections", "shard", "n_words")})
    docs = spark.createDataFrame([*docs.collect(), (None, None, None, None, None, *docs.columns[5:]), (7, "", "en", "a", 0, *docs.columns[5:])], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.where("copy <> 'copy' or mix_key <> 'mix_key' or shard <> 'shard'").count() == 0, name
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
