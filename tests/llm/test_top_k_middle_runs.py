"""Exact top-k search, fill-in-the-middle and periodic runs against brute force, on odd rows and clashing columns."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.llm import middle, nearest, periodic

VEC = "vec_id long, embedding array<float>, cell int, dist string, u string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], VEC)


def brute_top(rows, k=5):
    usable = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        mine = min(v for i, v in usable if i == q)
        others = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others)]
    return out


def answers(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_with_ties_copies_and_odd_rows(spark):
    r = np.random.default_rng(3)
    hot = r.normal(size=6).tolist()
    rows = [(i, r.normal(size=6).tolist()) for i in range(400)] + [(i, hot) for i in range(400, 700)]
    rows += [(i, [float(x) for x in r.integers(-1, 2, 6)]) for i in range(700, 900)]  # many ties
    rows += [(900, None), (901, [None, 1.0]), (902, [float("nan")]), (950, [float("inf")] * 6), (None, hot), (1000, []), (1001, [9.0]), (1050, hot[:3]), (-50, hot), (750, hot), (750, hot), (20, rows[20][1])]
    assert answers(nearest.top_k(vectors(spark, rows))) == brute_top(rows)


def test_top_k_searches_more_blocks_than_one(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 4)
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + r.normal(size=8) * 0.2).tolist()) for i in range(1500)]
    index = nearest.Index(vectors(spark, rows))
    index.search().count()
    assert answers(nearest.top_k(vectors(spark, rows))) == brute_top(rows)


def test_top_k_of_few_large_or_no_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])]
    assert answers(nearest.top_k(vectors(spark, few))) == brute_top(few)
    large = [(i, [float(np.float32((-1) ** i * 3e7 * (i + 1))), float(i)]) for i in range(60)]
    ends = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert [(q, k, ends(s)) for q, k, _, s in brute_top(large)] == [(q, k, s) for q, k, _, s in answers(nearest.top_k(vectors(spark, large)))]
    assert nearest.top_k(vectors(spark, few[:0])).count() == nearest.top_k(vectors(spark, few[1:2])).count() == 0
    assert nearest.top_k(vectors(spark, few), k=1, is_query=F.col("vec_id") == 1).collect() == [(1, 1, 0, 384 // 2 * 256)] or answers(nearest.top_k(vectors(spark, few), k=1, is_query=F.col("vec_id") == 1))[0][2] == 0


TEXTS = [None, "", " ", "\n\t", "a", " a", "a ", "one two  three\n", "has <P> in it", "<S>", "<M", "x < y <P >", "née € \U0001f600 mix\u00a0ed \u2003 spaces", "w " * 70_000, "word", "word"]


def test_fill_in_middle_by_hand(spark):
    import hashlib

    docs = spark.createDataFrame([(i, t, "f", 7) for i, t in enumerate(TEXTS * 12)] + [(None, "null id here", "f", 7)] * 2, "doc_id long, text string, form string, n_units int")
    made = middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "form", "n_units", "fim_text", "form_", "n_units_", "prefix_chars", "middle_chars"]
    back = middle.restore_text(made, form="form_").collect()
    forms = set()
    for r in back:
        t = r.text or ""
        unit = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        h = hashlib.sha256(f"42:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(unit)
        a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(x) for x in (unit[:a], unit[a:z], unit[z:]))
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n_units_, r.form_, r.fim_text, r.restored) == (n, form, want, t)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"} and len(back) == docs.count()
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("spm", [True, False])
def test_rotations_invert(spm):
    r = random.Random(1)
    for _ in range(300):
        t = bytes(r.choice(b"ab <>PSM \n") for _ in range(r.randint(1, 40)))
        if not re.search(b"<[PSM]>", t):
            a, z = sorted((r.randint(0, len(t)), r.randint(0, len(t))))
            assert middle.restore(middle.arrange(t, a, z, spm), "spm" if spm else "psm") == t


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, e = i - q, j
            if j > i and e - s >= max(6, 4 * q) and not any(all(w[x] == w[x - p] for x in range(s + p, e)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(r):
    k, w = r.choice([1, 2, 3, 5, 50]), []
    for _ in range(r.randint(0, 6)):
        if r.random() < 0.5:
            w += [str(r.randrange(k)) for _ in range(r.randint(0, 20))]
        else:
            b = [str(r.randrange(k)) for _ in range(r.randint(1, 25))]
            w += (b * r.randint(1, 9))[: -r.randint(1, 3)]
            if w and r.random() < 0.3:
                w[r.randrange(len(w))] = "z"
    return w


def test_runs_against_all_diagonals():
    r, found = random.Random(5), 0
    for _ in range(400):
        docs = [[x.encode() for x in periodic_text(r)] for _ in range(r.randint(1, 4))]
        for w, got in zip(docs, periodic.text_runs(docs)):
            assert got == brute_runs(w)
            found += len(got)
    assert found > 1000


def test_runs_of_odd_rows(spark):
    r = random.Random(6)
    texts = [None, "", " \n", "a " * 6, "a " * 5, "a\u00a0b " * 8, "x y x y x y x y z", "a b c " * 50_000, *(" ".join(periodic_text(r)) for _ in range(40))]
    docs = spark.createDataFrame([(None if i == 4 else i // 2, t, "runs", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n_words int")
    out = periodic.find_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "n_words", "n_words_", "runs_", "collapsed_text"]
    for row in out.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        want = brute_runs(w) if len(w) < 9999 else [(0, len(w), 3)]
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert (row.n_words_, [tuple(x) for x in row.runs_]) == (len(w), want) and row.collapsed_text == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.find_runs(docs.limit(0)).count() == 0
    assert periodic.repeat_tails(docs).where("doc_id is null").select("text").collect() == docs.where("doc_id is null").select("text").collect()
