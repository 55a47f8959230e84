"""Operators that only need ids to be comparable take strings as well as numbers."""

from waveloom.llm import decontaminate, jaccard, mixing, pseudonyms, quality, sharding, token_counts
from waveloom.llm.encoding import default_tokenizer

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [("b", BASE, "s"), ("a", BASE + " fifteen", "s"), ("c", "quite another text of some words that nobody else has at all here", "t"), (None, BASE, None), ("d", None, "t"), ("e", "", "")]


def test_string_ids(spark):
    df = spark.createDataFrame(ROWS, "doc_id string, text string, source string")
    groups = {(r.doc_id, r.component_id) for r in jaccard.similar_groups(df).collect()}
    assert groups == {("b", "a"), ("a", "a"), ("c", "c"), (None, "a"), ("d", "d"), ("e", "e")}
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == {"a", "c", "d", "e"}
    items = spark.createDataFrame([("x", BASE), ("y", "nobody else has")], "item_id string, text string")
    found = {r.doc_id: r["items"] for r in decontaminate.find_contamination(df, items).collect()}
    assert found == {"a": ["x"], "b": ["x"], None: ["x"], "c": ["y"], "d": [], "e": []}
    labels = spark.createDataFrame([("a", 1)], "doc_id string, quality int")
    assert {r.doc_id for r in quality.keep_good(df, quality.fit_quality(df, labels)).collect()} == {"a", "b", "c", None}
    assert token_counts.count_by_section(df, default_tokenizer()).count() == 6
    assert sharding.shard_rows(df, 2).count() == 6
    assert {r.source for r in mixing.mix_sources(df, total=60).collect()} == {"s", "t", "", None}
    assert pseudonyms.pseudonymize(df, "k").count() == 6
