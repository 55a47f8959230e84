"""Layouts that training has not seen, malformed markup, and what the labeller's training takes from the table."""

from collections import Counter

import numpy as np
import pytest

from waveloom.llm import extract
from waveloom.llm.blocks import leaf_blocks

from templates import TEMPLATES, make_page

WORDS = [a + b for a in "foo bar baz quux corge grault".split() for b in "lor mis ten pro qua und ein ver".split()]


@pytest.fixture(scope="module")
def model(spark):
    return extract.fit_labeller(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("name", TEMPLATES)
def test_held_out_layouts(model, name):
    rng = np.random.default_rng(TEMPLATES.index(name))
    pages = [make_page(name, rng, WORDS) for _ in range(40)]
    hit = want = got = 0
    for (_, text), out in zip(pages, extract.page_texts(model, [p for p, _ in pages])):
        a, b = Counter(text.split()), Counter(out.split())
        hit, want, got = hit + sum((a & b).values()), want + sum(a.values()), got + sum(b.values())
    print(name, hit / want, hit / got)
    assert hit / want >= 0.95 and hit / got >= 0.95, (name, hit / want, hit / got)


@pytest.mark.parametrize("page, texts", [
    ("<div><p title=it's>one</p><p>don't</p></div>", ["one", "don't"]),
    ('<article><p>a</p><svg><path d="x"><title>t</title><p>b</p></article><footer>f</footer>', ["a", "b", "f"]),
    ("<div><svg><g></g> x</svg>after</div><math>m</math>w<svg/>v", ["after", "w v"]),
    ("<div><noscript><p>no</p></div><p>yes</p><div><template><i>t</div>z", ["yes", "z"]),
    ('<p a="b>c" d=\'e>f\' g=h"i>text</p><p a="open>x</p><p>y', ["text", "x", "y"]),
    ("<!--><p>u<br/>v</p><script>if (a<b) '</p>'", ["u v"]),
    ("1 < 2 and 4 > 3 <", ["1 < 2 and 4 > 3 <"]),
])
def test_malformed_markup(page, texts):
    assert [b.text for b in leaf_blocks(page)] == texts


def test_scan_is_linear():
    for page in ("<p " + "a=b " * 300_000, "<p " + 'a="' * 200_000, "<" * 300_000, "<div>" * 50_000 + "x"):
        leaf_blocks(page)


def test_no_pages_to_learn_from(spark):
    empty = spark.createDataFrame([], "page_id string, url string, html string, h int, x string")
    m = extract.fit_labeller(empty, n_composed=30)
    odd = spark.createDataFrame([("a", None, None, 1, "x"), (None, "u", "<p>" + "word " * 50_000, 1, "x"), ("b", "u", "<article></article>", 1, "x")], empty.schema)
    got = extract.extract_text(odd, m).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    again = extract.fit_labeller(odd.unionByName(odd), n_composed=30)
    assert {k: v.shape for k, v in again.items()} == {k: v.shape for k, v in m.items()}
