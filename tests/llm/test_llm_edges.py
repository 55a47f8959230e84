"""Every numbered operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waveloom.llm import decontaminate, extract, gbdt, jaccard, lstm, mixing, packing, pseudonyms, quality, sharding, token_counts, warc
from waveloom.llm.blocks import leaf_blocks
from waveloom.llm.encoding import Encoder, default_tokenizer
from waveloom.llm.shared import new_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, node long, copy int, _hits int, n_replaced string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, 9, 3, "x") for i, t, s in zip(ids, texts, sources)], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", ".", ",", ""]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, white space only, a very long text, ties and repeated rows, with a null id among them."""
    texts = [None, "", " \n\t ", prose(1, 60_000), prose(2, 200), prose(2, 200), prose(2, 200) + " omega", "one two", "one two", "One TWO", "née dé — ü x", prose(3, 80), prose(3, 80)]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, None, 11]
    return make(spark, texts, ids), list(zip(ids, texts))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# token counts and ids

def test_token_counts(spark, odd):
    df, rows = odd
    enc = Encoder(default_tokenizer()).tokenizer
    got = token_counts.count_by_section(df, default_tokenizer()).toPandas()
    total = got.groupby(got.doc_id.fillna(-1)).n_tokens.sum().to_dict()
    want = Counter()
    for i, t in rows:
        want[-1 if i is None else i] += len(enc.encode(t or "", add_special_tokens=False).ids)
    assert total == dict(want)
    assert token_counts.count_by_section(df.limit(0), default_tokenizer()).count() == 0
    assert token_counts.count_by_section(df.withColumn("sections", F.lit("x")), default_tokenizer()).count() == len(got)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_over_edges(spark, rule):
    text = "Hello wonderful world\n\nagain é€ tail"
    enc = Encoder(default_tokenizer()).tokenizer
    offsets = enc.encode(text, add_special_tokens=False).offsets
    cuts = [(0, 3), (3, 8), (9, 24), (26, len(text))]
    df = spark.createDataFrame([(1, text, cuts), (2, None, cuts), (3, text, None), (4, text, [])], "doc_id long, text string, sections array<struct<start:int,stop:int>>")
    got = token_counts.count_by_section(df, default_tokenizer(), rule, "sections").toPandas()
    mine = {r.section: r.n_tokens for r in got[got.doc_id == 1].itertuples()}
    want = Counter()
    for s, e in offsets:
        touch = [k for k, (a, b) in enumerate(cuts) if min(e, b) > max(s, a)]
        want[-1 if not touch else touch[0] if rule == "first" else touch[-1] if rule == "last" else max(touch, key=lambda k: (min(e, cuts[k][1]) - max(s, cuts[k][0]), -k))] += 1
    assert {k: v for k, v in mine.items() if v} == dict(want)
    assert got[got.doc_id == 3].n_tokens.sum() == len(offsets) == got[got.doc_id == 4].n_tokens.sum()


def test_pieces_encode_like_whole_texts():
    e = Encoder(default_tokenizer())
    r = random.Random(4)
    texts = [None, "", "a" * 5000, "it's 'tis <|endoftext|>x <|endoftext|>", " \u0085 nel 　 x", "\U0001f600 b\n\nc \r\n d"]
    texts += ["".join(r.choice(" \n\t'.,abéZ1 你<|>ś") for _ in range(r.randrange(80))) for _ in range(2000)]
    ids, counts = e.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in e.tokenizer.encode(t or "", add_special_tokens=False).ids]
    assert counts.sum() == len(ids)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31])
def test_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    data = packing.pack(x, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert packing.unpack(data, bits, 0, 1001).tolist() == x.tolist() and packing.unpack(data, bits, 333, 777).tolist() == x[333:777].tolist()
    assert packing.bits_for(1 << bits) == bits


def test_token_files(spark, odd):
    df, rows = odd
    enc = Encoder(default_tokenizer()).tokenizer
    manifest = packing.write_ids(df, new_path(spark, "t"), default_tokenizer(), shards=3)
    got = packing.read_ids(manifest).orderBy("start").collect()
    want = sorted((-1 if i is None else i, len(ids := enc.encode(t or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    f = packing.Reader(manifest.first().uri)
    assert f.ids(2, 5).tolist() == f.ids(0, f.n_ids).tolist()[2:5]
    f.close()
    assert packing.read_ids(packing.write_ids(df.limit(0), new_path(spark, "t"), default_tokenizer())).count() == 0
    whole = packing.read_ids(manifest, digest=False).where("doc_id = 8").first()
    assert whole.ids == enc.encode("One TWO", add_special_tokens=False).ids + [0]


def test_one_id_over_several_shards(spark):
    df = make(spark, [prose(i, 5) for i in range(90)], [1] * 60 + list(range(2, 32)))
    got = packing.read_ids(packing.write_ids(df, new_path(spark, "t"), default_tokenizer(), shards=6)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 90


# archives

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int, refers_to int")


def test_archives(spark):
    big, long = "ü" * 600, "x" * (3 * warc.CHUNK + 17)
    rows = [(1, "http://a/ü b", big, 1, 1), (2, None, big, 1, 1), (3, "u", "small", 1, 1), (4, "u", "small", 1, 1), (5, "u", None, 1, 1), (6, "u", "", 1, 1), (7, "u", long, 1, 1), (8, "v", long, 1, 1), (9, "q\"\\\r\n", big, 1, 1), (9, "again", big, 1, 1), (None, "n", big, 1, 1), (None, "n", "only here" * 200, 1, 1)]
    df = pages(spark, rows)
    manifest = warc.write_archives(df, new_path(spark, "w"))
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    best = {}
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        best[b] = max(best.get(b, -1), -1 if p is None else p)
    assert Counter((r.page_id, r.url) for r in got) == Counter((p, u) for p, u, *_ in rows)
    for r in got:
        b = next(x for p, _, h, *_ in rows for x in ((h or "").encode(),) if p == r.page_id and hashlib.sha1(x).hexdigest() == r.payload_digest)
        revisit = len(b) >= 1000 and best[b] not in (r.page_id, -1)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best[b] if revisit else None)
    chunks = warc.read_archives(manifest, payloads=True).where("page_id = 8").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.data) for c in chunks) == long.encode() and [c.last for c in chunks] == [False] * 3 + [True] and chunks[-1].sha1 == hashlib.sha1(long.encode()).hexdigest()
    table = warc.record_table(df).where("page_id = 7").orderBy("chunk_no").collect()
    assert [len(c.data) for c in table] == [warc.CHUNK] * 3 + [17] and [c.length for c in table] == [warc.CHUNK * k for k in (1, 2, 3)] + [len(long)]
    assert table[-1].sha1 == hashlib.sha1(long.encode()).hexdigest()
    small = warc.write_archives(df, new_path(spark, "w"), chunk=100)
    assert warc.record_table(df, 100).agg(F.max(F.octet_length("data"))).first()[0] == 100
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, warc.read_archives(small).collect())) == sorted(map(key, got))
    ids = [h["WARC-Record-ID"] for m in manifest.collect() for h, _ in warc.RecordReader(m.uri).records()]
    assert len(set(ids)) == len(rows)
    refers = [h["WARC-Refers-To"] for m in manifest.collect() for h, _ in warc.RecordReader(m.uri).records() if "WARC-Refers-To" in h]
    assert refers and set(refers) <= set(ids)
    names = spark.createDataFrame([("a\nb", "u", big), ("z", "u", big)], "page_id string, url string, html string")
    back = warc.read_archives(warc.write_archives(names, new_path(spark, "w")), page_type="string").collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in back} == {("a\nb", "revisit", "z"), ("z", "response", None)}
    assert warc.read_archives(warc.write_archives(df.limit(0), new_path(spark, "w"))).count() == 0


# decontamination

def brute_hits(text, items, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, ids = set(), set()
    for i, t in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        size = min(window, len(x))
        wins = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if size else set()
        for p in range(len(w) - size + 1 if size else 0):
            if tuple(w[p : p + size]) in wins:
                hit.update(range(p, p + size))
                ids.add("null" if i is None else str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, odd, broadcast):
    _, rows = odd
    texts = [t for _, t in rows] + [prose(1, 60_000)[2000:2600] + " zzz " + prose(9, 30), "Alpha, beta!", "tail " + prose(2, 14)]
    items = [(1, prose(2, 14)), (2, "ALPHA beta"), (3, None), (4, ""), (5, prose(1, 60_000)[2000:2300]), (6, prose(2, 14)), (7, "..."), (None, prose(3, 12)), (8, "solo")]
    df = make(spark, texts)
    got = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(texts[r.doc_id], items), r.doc_id
        assert r.contaminated == (r.n_hit > 0)
    clean = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast, keep="clean")
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.contaminated}
    none = decontaminate.find_contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)
    assert decontaminate.find_contamination(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# quality rules

def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep)


def test_quality(spark, odd):
    df, rows = odd
    more = ["a b\na b\n \n#$ | x", "u v w x y z u v w x y z", "ok " * 30]
    df = df.unionByName(make(spark, more, [100, 101, 102]))
    rows = rows + list(zip([100, 101, 102], more))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    got = quality.score_quality(df, model).collect()
    want = Counter()
    for i, t in rows:
        c = brute_counts(t)
        want[(i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.keep_good(df, model).count() == sum(r.kept for r in got)
    assert quality.score_quality(df.limit(0), quality.fit_quality(df.limit(0), labels)).count() == 0


def test_trees_learn_and_stay_monotone():
    r = np.random.default_rng(1)
    x = r.uniform(0, 1, (4000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * r.standard_normal(4000) > 0.6).astype(int)
    m = gbdt.fit(x[:3000], y[:3000], (1, 0, -1))
    assert ((m.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.88
    base = r.uniform(0, 1, (50, 3))
    for j, sign in ((0, 1), (2, -1)):
        z = np.repeat(base[:, None], 40, axis=1)
        z[:, :, j] = np.linspace(0, 1, 40)
        p = m.raw(z.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(p, axis=1) >= -1e-9).all()
    assert gbdt.fit(x[:0], y[:0], (0, 0, 0)).probability(x[:3]).tolist() == [0.5] * 3


# extraction

def test_blocks():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><!-- <p>no</p> --><p>a&amp;b <b>c<br>d</p><ul><li>x<li>y</ul><div class="k">t &lt;e'
    assert [b.text for b in leaf_blocks(page)] == ["a&b c d", "x", "y", "t <e"]
    assert leaf_blocks(None) == [] == leaf_blocks("") and leaf_blocks("<p>cut <a href='x") [0].text == "cut"
    assert leaf_blocks(page)[3].path[-1] == "div.k"


def test_lstm_gradients():
    r = np.random.default_rng(0)
    m = {k: v.astype(float) for k, v in lstm.new_model(5, 4, 3, 1).items()}
    x, mask = lstm.padded([r.standard_normal((6, 5)), r.standard_normal((2, 5))])
    want = r.random((6, 2)) > 0.5
    g, _ = lstm.gradients(m, x, mask, want)
    for k, v in m.items():
        at = tuple(n // 2 for n in v.shape)
        keep = v[at]
        v[at] = keep + 1e-3
        up = lstm.gradients(m, x, mask, want)[1]
        v[at] = keep - 1e-3
        down = lstm.gradients(m, x, mask, want)[1]
        v[at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4, k


def test_extraction(spark):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    body = lambda: " ".join(f"<p>{' '.join(rng.choice(words, 30))}.</p>" for _ in range(4))
    rows = [(i, f"u{i}", f"<html><body><nav><ul><li><a href='/'>home</a></li><li><a href='/b'>{words[i]}</a></li></ul></nav><div class='ad'>{' '.join(rng.choice(words, 6))}.</div><article><h1>{words[i]} title</h1>{body()}</article><footer>&copy; site {words[i]}.</footer></body></html>", 5) for i in range(40)]
    rows += [(90, None, None, 5), (91, "u", "", 5), (92, "u", "plain", 5), (40, "u", rows[0][2], 5), (40, "u", rows[0][2], 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    model = extract.fit_labeller(df, n_pages=30, n_composed=200)
    got = {r.page_id: r for r in extract.extract_text(df, model).collect()}
    for i, _, h, _ in rows[30:40]:
        inner = re.search("<article>(.*)</article>", h)[1]
        assert got[i].text == re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", inner)).strip() and got[i].n_chars == len(got[i].text)
    assert got[90].text == "" == got[91].text and got[90].n_chars == 0
    assert extract.extract_text(df.limit(0), model).count() == 0


def test_composed_pages_are_learnt():
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    data = [extract.compose(rng, words) for _ in range(500)]
    m = lstm.train([extract.vectors(b) for b, _ in data[:400]], [y for _, y in data[:400]])
    ok = np.concatenate([(s > 0) == y for s, (_, y) in zip(lstm.predict(m, [extract.vectors(b) for b, _ in data[400:]]), data[400:])])
    assert ok.mean() > 0.93


# sharding

def test_ring_shards(spark, odd):
    df, rows = odd
    big = df.unionByName(make(spark, [prose(i, 20 + i % 50) for i in range(1500)], [i % 1200 for i in range(1500)])).unionByName(make(spark, ["same"] * 700, [5] * 700))
    got = sharding.shard_rows(big).toPandas()
    assert len(got) == big.count()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    small = sharding.shard_rows(make(spark, [prose(i, 20 + i % 50) for i in range(3000)])).toPandas()
    size = small.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() < 1.02 * size.mean() and size.min() > 0.9 * size.mean()
    again = sharding.shard_rows(big.repartition(5)).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(got[key].fillna(-1).itertuples(index=False, name=None)) == sorted(again[key].fillna(-1).itertuples(index=False, name=None))
    nul = got[(got.doc_id == 0) & (got["size"] == 1)]
    assert len(nul) and (nul.text_crc32 == 0).all()
    assert sharding.shard_rows(df.limit(0)).count() == 0


def test_ring_moves_little():
    loads = {p: int(x) for p, x in enumerate(np.random.default_rng(0).gamma(1, 3000, sharding.PLACES))}
    total = sum(loads.values())

    def owners(shards):
        out = {}
        for p, x in sharding.plan(loads, shards).items():
            ends = [f for f, _ in x[1:]] + [loads[p]]
            out[p] = [(f, e, s) for (f, s), e in zip(x, ends)]
        return out

    a, b = owners(8), owners(9)
    for o, n in ((a, 8), (b, 9)):
        held = Counter()
        for x in o.values():
            for f, e, s in x:
                held[s] += e - f
        assert sum(held.values()) == total and max(held.values()) <= 1.002 * total / n + 1
    same = sum(max(0, min(e, e2) - max(f, f2)) for p in loads for f, e, s in a.get(p, []) for f2, e2, s2 in b.get(p, []) if s == s2)
    assert 1 - same / total < 0.16  # a ninth has to move


# pseudonyms

def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark, odd):
    texts = ["card 4532015112830366 and 4532-0151-1283-0366.", "bad 4532015112830367", "a.b-9@Mail.example.com, jo.12@x.org", "+1 (974) 555-3436 or 212-555-0199 or +1 (074) 155-3436", "ip 10.20.30.255 not 300.1.1.1 nor 1.2.3.4.5",
             "on 2024-02-29, 31/12/1999, 05.06.2001; not 2023-02-30", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, "", "clean text 42", "4532015112830366 4532015112830366 123"]
    df = make(spark, texts)
    out = pseudonyms.pseudonymize(df, "k")
    assert out.columns == df.columns + ["n_replaced_"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].n_replaced_ for i in range(len(texts))] == [2, 0, 2, 3, 1, 3, 1, 0, 0, 0, 2]
    for i in (1, 7, 8, 9):
        assert got[i].text == texts[i]
    for i, t in enumerate(texts):
        assert t is None or len(got[i].text) == len(t) or i == 4
        assert t is None or i in (4,) or re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t))) == re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", got[i].text))) or i == 6
    a, b = re.findall(r"[0-9-]{16,}", got[0].text)
    assert a == b.replace("-", "") != "4532015112830366" and luhn(a) and re.findall(r"[0-9]{16}", got[10].text) == [a, a]
    assert "300.1.1.1" in got[4].text and "1.2.3.4.5" in got[4].text and "2023-02-30" in got[5].text and "10.20.30.255" not in got[4].text
    back = pseudonyms.pseudonymize(out.drop("n_replaced_"), "k", inverse=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
    assert {r.text for r in pseudonyms.pseudonymize(df, key="other").collect()} != {r.text for r in out.collect()}
    assert pseudonyms.pseudonymize(odd[0].limit(0), "k").count() == 0


def test_pseudonyms_are_permutations(spark):
    ids = spark.range(1000)
    a = ids.select(pseudonyms.permute_pair(F.floor(F.col("id") / 40), F.col("id") % 40, 25, 40, "k", "t").alias("x")).select("x.a", "x.b").distinct()
    assert a.count() == 1000 and a.where("a < 0 or a >= 25 or b < 0 or b >= 40").count() == 0
    d = ids.select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")).select(pseudonyms.date(F.col("d"), "k").alias("p"))
    assert d.distinct().count() == 1000 and d.where("p is null").count() == 0


# near duplicates

def brute_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {}
    for g in groups.values():
        known = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            least[i] = min(known) if known else None
    return [(rows[i][0], len(sets[i]), least[i] if sets[i] else rows[i][0]) for i in range(len(rows))]


def edited(seed, base, n):
    r = random.Random(seed)
    w = base.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("hubs", [0, 4])
def test_components(spark, odd, hubs, monkeypatch):
    """Chains, copies, near copies around the threshold, a passage that all share, and one group of many."""
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(jaccard, "PAIRS_A_NODE", 0)
    words = [f"w{i}" for i in range(3000)]
    r = random.Random(3)
    fresh = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = list(odd[1])
    common, base = fresh(60), fresh(150)
    rows += [(1000 + i, common + " " + fresh(80)) for i in range(60)]
    rows += [(2000 + i, edited(i, base, i % 9)) for i in range(120)]
    chain = base2 = fresh(100)
    for i in range(25):
        chain = edited(50 + i, chain, 2)
        rows.append((3000 - i, chain))
    rows += [(4000 + i, base2) for i in range(30)] + [(5000 + i, " ".join(base2.split()[: 100 - i])) for i in range(40)]
    r.shuffle(rows)
    df = make(spark, [t for _, t in rows], [i for i, _ in rows])
    got = jaccard.similar_groups(df).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(key((g.doc_id, g.n_shingles, g.component_id)) for g in got) == sorted(map(key, brute_components(rows)))


def test_one_of_each_group_stays(spark, odd):
    df, rows = odd
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    groups = {}
    for (i, t), (_, n, c) in zip(rows, brute_components(rows)):
        groups.setdefault(c if n else ("empty", i), []).append((i, t))
    assert sum(got.values()) == len(groups) and all(v == 1 for v in got.values())
    assert jaccard.keep_one(df.limit(0)).count() == 0


# mixing

def test_mixing(spark, monkeypatch):
    n = {"a": 3000, "b": 900, None: 600, "c": 30}
    rows = [(k * 10_000 + i, s) for k, (s, m) in enumerate(n.items()) for i in range(m)]
    df = make(spark, ["t"] * len(rows), [i for i, _ in rows], [s for _, s in rows])
    out = mixing.mix_sources(df).groupBy("source").count().collect()
    total = sum(r["count"] for r in out)
    assert abs(total / len(rows) - 1) < 0.06
    for r in out:
        assert abs(r["count"] / (len(rows) / 4) - 1) < (0.5 if r.source == "c" else 0.12), r
    some = mixing.mix_sources(df, {"a": 3, "b": 1}, total=2000).toPandas()
    assert set(some.source) == {"a", "b"} and abs((some.source == "a").sum() / 1500 - 1) < 0.1
    assert list(some.columns) == df.columns + ["copy_", "mix_key"] and set(some["copy"]) == {9}
    counts = some.groupby("doc_id").copy_.agg(["count", "max"])
    assert (counts["count"] == counts["max"] + 1).all()
    again = mixing.mix_sources(df.repartition(9), {"a": 3, "b": 1}, total=2000).toPandas()
    assert sorted(zip(some.doc_id, some["copy_"])) == sorted(zip(again.doc_id, again["copy_"]))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    joined = mixing.mix_sources(df, {"a": 3, "b": 1}, total=2000).toPandas()
    assert sorted(zip(some.doc_id, some["copy_"])) == sorted(zip(joined.doc_id, joined["copy_"]))
    many = mixing.mix_sources(df.where("doc_id = 1"), total=1700).count()  # a mean above the largest single draw
    assert abs(many - 1700) < 200
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_sources(df, {}).count() == 0
