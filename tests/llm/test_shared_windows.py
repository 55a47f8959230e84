"""Text that many benchmark items share is looked for once, and its items are joined once for each document."""

import random

from pyspark.sql import functions as F

from waveloom.llm import decontaminate
from waveloom.llm.shared import Scratch

WORDS = [f"w{i}" for i in range(5000)]


def test_items_times_documents(spark):
    r = random.Random(3)
    template = " ".join(r.sample(WORDS, 40))
    items = spark.createDataFrame([(i, template + (" " + " ".join(r.sample(WORDS, 15)) if i % 3 else "")) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(r.sample(WORDS, 5)) + " " + template) for i in range(300)] + [(999, "clean " * 30)], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    _, hits, owners = decontaminate.find_hits(docs, items, scratch, 10, 3, 200_000)
    assert hits.count() == 300 * 31 and hits.distinct().count() == 300 * 31  # 9,300 occurrences
    met = hits.select("k", "h", "c").distinct().join(owners, "c").count()
    assert met <= 300 * 300 * 2
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate.find_contamination(docs, items).collect()}
    assert got.pop(999) == (0, 0) and set(got.values()) == {(40, 300)}


def test_filters_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LISTED", 10)
    tokens = spark.range(5000).select(F.xxhash64("id").alias("token"))
    bits, bitmap, keys = decontaminate._filter(tokens)
    import numpy as np

    own = np.array([x.token for x in tokens.collect()], np.int64).view(np.uint64)
    other = np.array([x.token for x in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("token")).collect()], np.int64).view(np.uint64)
    assert keys is None and bits == 20 and len(decontaminate._marked((bits, bitmap, keys), own)) == 5000 and len(decontaminate._marked((bits, bitmap, keys), other)) < 400
