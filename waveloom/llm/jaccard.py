"""Exact n-gram Jaccard self-join under several global token orders.

Each document is the set of its distinct word n-grams, as 64-bit hashes. Documents with the same set
are one node. Two sets of a and b elements are linked when they share enough: 100 * o >= p * (a + b - o).
Linked sets share a token of their prefixes under every global order of the tokens, so each order is a
filter and the candidates are what all of them leave:

1. ascending hash. Prefixes longer by n/8 must share n/8 tokens, so a document with fewer such tokens found
   in any other document is out. This needs no statistics and leaves few documents;
2. ascending frequency among those that are left (ties by hash): all tokens found once come first, and pairs
   come only from the rare tokens of the prefixes, with length and positional bounds;
3. ascending and descending hash again, on each pair, before its sets are compared in full.

The smaller set of a linked pair holds their first common token early: what follows it there must be
p / (100 + p) of twice its own size. Such rows are `low`, a token without one has no candidates, and only pairs
with a low row on their smaller side are formed.

The result needs components only, so pairs inside one component are never formed: each token's documents are
first compared with one hub (a few rounds), components are merged, and then all pairs of different
components that are left are compared. No link between different components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, save, table, worker
from .textbytes import NOT_SPACE, counts_by_row, lower_ascii, mix, slices, span_hashes, spans, text_bytes, windows

#: Tables of a few numbers a row, of counted size up to this, are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Tokens a task remembers as shared (8 bytes each), so that it sends them no more; beyond that it sends them again.
REMEMBERED = 1_000_000
#: Rounds of comparing with hubs before all pairs between components are formed, at most, and how
#: many pairs for each node end these rounds early.
HUB_ROUNDS, PAIRS_A_NODE = 4, 4


def token_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, one text after the other; and how many each has.
    A text of fewer words is one n-gram; one without words has none."""
    buf, off = text_bytes(texts)
    low = lower_ascii(buf)
    s, e, row = spans(low, off, NOT_SPACE)
    h, n = span_hashes(low, s, e), len(off) - 1
    g, at = windows(h, row, width)
    grow = row[at]
    words = counts_by_row(row, n)
    for k in range(1, width):
        few = np.flatnonzero(words[row] == k)
        if len(few):
            gk, ak = windows(h[few], row[few], k)
            g, grow = np.concatenate([g, mix(gk + np.uint64(k))]), np.concatenate([grow, row[few][ak]])
    o = np.lexsort((g, grow))
    g, grow = g[o], grow[o]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (grow[1:] != grow[:-1])
    return g[first], counts_by_row(grow[first], n)


def node_ids(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, equal for equal sets; 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(counts)
    out = mix(sums[ends] - sums[ends - counts] + mix(counts.astype(np.uint64)))
    out[counts == 0] = 0
    return out


def least_share(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n tokens with any set it is linked with."""
    return -(-percent * n // 100)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n, node of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                tokens, n = token_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int32()), pa.array(node_ids(tokens, n).view(np.int64))], names=["doc_id", "text_hash", "n", "node"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(worker(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n int, node long")


def _shared_prefix(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Nodes that pass the first order: node, and how many tokens of its longer prefix other nodes hold too.

    A token that several nodes of one slice hold is counted for these nodes at once and sent once; the task
    then remembers it as shared, counts it at once for later nodes too, and sends it no more. So a token of very many
    documents is one row a task after the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.zeros(0, np.uint64)
        for b in batches:
            for part in slices(b, "text"):
                tokens, n = token_sets(part.column("text"), width)
                node = node_ids(tokens, n)
                ends = np.cumsum(n)
                rank = np.arange(len(tokens)) - np.repeat(ends - n, n)
                fresh = np.zeros(len(n), bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                keep = (rank < np.repeat(n - least_share(n, percent) + n // 8 + 1, n)) & np.repeat(fresh, n)
                t, d = tokens[keep], np.repeat(node, n)[keep]
                o = np.argsort(t, kind="stable")
                t, d = t[o], d[o]
                head = np.ones(len(t), bool)
                head[1:] = t[1:] != t[:-1]
                group = np.cumsum(head) - 1
                sent = shared[np.minimum(np.searchsorted(shared, t), len(shared) - 1)] == t if len(shared) else np.zeros(len(t), bool)
                many = sent | (np.bincount(group, minlength=1)[group] > 1) if len(t) else head
                u, c = np.unique(d[many], return_counts=True)
                if len(shared) < REMEMBERED:
                    shared = np.union1d(shared, t[head & many & ~sent])
                head &= ~sent
                t, d = t[head], np.where(many, np.uint64(0), d)[head]
                o = np.argsort(d, kind="stable")  # rows of one node together take less room
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t[o], mix(u)]).view(np.int64)), pa.array(np.concatenate([d[o], u]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(t), np.int32), c.astype(np.int32)]))], names=["token", "node", "here"])

    rows = docs.select("text").mapInArrow(worker(run), "token long, node long, here int")
    found = rows.withColumn("slices", F.count(F.lit(1)).over(W.partitionBy("token")))
    return (found.where("node <> 0 and (here > 0 or slices > 1)").groupBy("node").agg(F.sum(F.when(F.col("here") > 0, F.col("here")).otherwise(1)).alias("shared")))


def _node_tokens(docs: DataFrame, wanted: DataFrame, width: int, few: bool) -> DataFrame:
    """node, n, tokens of the documents that stand for the wanted nodes (k, node, many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                tokens, n = token_sets(part.column("text"), width)
                node = node_ids(tokens, n).view(np.int64)
                own = np.flatnonzero(node == part.column("node").to_numpy())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(n[own], pa.int32()), lists.take(pa.array(own)), part.column("many").take(pa.array(own))], names=["node", "n", "tokens", "many"])

    rows = docs.select(F.xxhash64("doc_id").alias("k"), "text").join(F.broadcast(wanted) if few else wanted, "k").select("text", "node", "many")
    return rows.mapInArrow(worker(run), "node long, n int, tokens array<long>, many boolean")


def _least(n, percent: int):
    return F.ceil(F.lit(percent) * n / F.lit(100)).cast("int")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: both hash orders' prefixes first, then whole sets."""
    few = pairs.count() <= BROADCAST_ROWS  # two numbers a pair
    side = lambda ids: F.broadcast(ids) if few else ids
    # only the sets that are asked for are shuffled
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(side(pairs.select("a").distinct()), "a", "left_semi")
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")).join(side(pairs.select("b").distinct()), "b", "left_semi")
    both = b.join(side(pairs.select("a", "b")), "b").join(a, "a")
    pa_, pb = F.col("na") - _least(F.col("na"), percent) + 1, F.col("nb") - _least(F.col("nb"), percent) + 1
    up = F.arrays_overlap(F.slice("ta", F.lit(1), pa_), F.slice("tb", F.lit(1), pb))
    down = F.arrays_overlap(F.slice("ta", F.col("na") - pa_ + 1, pa_), F.slice("tb", F.col("nb") - pb + 1, pb))
    o = F.size(F.array_intersect("ta", "tb"))
    return both.where(up & down).where(o * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def merge_labels(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, comp) after joining the components of all links (a, b): comp becomes the least label of
    what is connected. Least neighbours and pointer jumping, so rounds grow with the logarithm of a chain's length."""
    x, y = labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), labels.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    edges = scratch.save(links.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    while not edges.isEmpty():
        ends = edges.select(F.col("x").alias("v"), F.col("y").alias("u")).union(edges.select("y", "x"))
        up = scratch.save(ends.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("p")), "parents")
        while True:
            over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = scratch.save(up.join(over, "p").select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "parents")
            up = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        labels = scratch.save(labels.join(up.withColumnRenamed("v", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        x, y = up.select(F.col("v").alias("x"), F.col("p").alias("rx")), up.select(F.col("v").alias("y"), F.col("p").alias("ry"))
        edges = scratch.save(edges.join(x, "x").join(y, "y").where("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "edges")
    return labels


def _components(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """labels (node, comp) of the nodes that may have links, given their token sets."""
    own = sets.select("node", "n", F.explode("tokens").alias("token"))
    # written first: the join then has plain shuffles on both sides, which a hot token cannot hold up
    often = scratch.save(own.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    found = own.join(often, "token")
    by_node = W.partitionBy("node")  # the tokens of one document
    found = found.withColumn("shared", F.count(F.lit(1)).over(by_node)).where(F.col("shared") >= _least(F.col("n"), percent))
    # tokens of no other node stand before all others
    found = found.withColumn("pos", F.col("n") - F.col("shared") + F.row_number().over(by_node.orderBy("often", "token")) - 1)
    prefix = scratch.save(found.where(F.col("pos") <= F.col("n") - _least(F.col("n"), percent)).select("token", "node", F.col("n").cast("int"), F.col("pos").cast("int"), (1 - F.col("shared") / F.col("n")).alias("own"), ((F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n")).alias("low")), "prefixes")
    labels = scratch.save(prefix.select("node").distinct().withColumn("comp", F.col("node")), "labels")
    nodes = labels.count()
    side = lambda df: F.broadcast(df) if nodes <= BROADCAST_ROWS else df  # noqa: E731  at most one row for each node
    sets = sets.select("node", "n", "tokens")
    fits = (F.lit(100) * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
    hubs_left = HUB_ROUNDS
    for turn in range(HUB_ROUNDS + 1):
        now = prefix.join(side(labels), "node")
        groups = now.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.count_if("low").alias("l"))
        open_ = groups.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), (F.sum("c") * F.sum("l") - F.sum(F.col("c") * F.col("l"))).alias("pairs")).where("comps > 1 and pairs > 0")
        open_ = scratch.save(open_.select("token", "pairs"), "open-tokens")
        left = open_.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        # a token whose documents are in one component stays so: the others alone go on
        few = open_.count() <= BROADCAST_ROWS
        prefix = scratch.save(prefix.join(F.broadcast(open_.select("token")) if few else open_.select("token"), "token", "left_semi"), "prefixes")
        active = prefix.join(side(labels), "node")
        if hubs_left and left > PAIRS_A_NODE * nodes:
            # the documents with the least of their own are the likeliest centres; later rounds take them from a half of all
            h = F.xxhash64("node", F.lit(turn))
            order = F.struct((F.pmod(h, F.lit(2)) if turn else F.lit(0)).alias("half"), "own", h.alias("h"), "node", "n", "pos", "comp")
            hubs = scratch.save(active.groupBy("token").agg(F.min(order).alias("hub")).select("token", F.col("hub.node").alias("a"), F.col("hub.n").alias("na"), F.col("hub.pos").alias("pa"), F.col("hub.comp").alias("ca")), "hubs")
            hubs = F.broadcast(hubs) if few else hubs  # one row for each open token
            pairs = active.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb")).join(hubs, "token").where(F.col("ca") != F.col("cb")).where(fits)
            shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
            best = scratch.save(shared.groupBy("b").agg(F.max(F.struct("c", "a")).alias("x")).select(F.col("x.a").alias("a"), "b"), "pairs")
            links = scratch.save(_linked(best, sets, percent), "links")
            labels = merge_labels(labels, links, scratch)
            hubs_left = 0 if links.count() * 100 < nodes else hubs_left - 1  # rounds that find little end
            continue
        # the bounds of a whole component come first: most components that share a token cannot have links
        numbers = (F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))
        x, y = (rows.groupBy("token", "comp").agg(*numbers).select("token", *[F.col(c).alias(c + z) for c in ("comp", "c", "least", "most", "rest")]) for rows, z in ((active.where("low"), "a"), (active, "b")))
        may = (F.col("leasta") <= F.col("mostb")) & (F.lit(100) * F.col("mosta") >= percent * F.col("leastb")) & (F.least("resta", "restb") * (100 + percent) >= percent * (F.col("leasta") + F.col("leastb")))
        sides = scratch.save(x.join(y, "token").where(F.col("compa") != F.col("compb")).where(may).select("token", (F.col("ca") <= F.col("cb")).alias("a_less"), F.col("compa").alias("ca"), F.col("compb").alias("cb")), "sides")
        a = active.where("low").select("token", F.col("comp").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
        b = active.select("token", F.col("comp").alias("cb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
        # the side with fewer documents is written out first; of two low rows of one size the pair comes up from both sides
        fits &= F.col("na") <= F.col("nb")
        both = [sides.where(which).join(s, ["token", s.columns[1]]).join(t, ["token", t.columns[1]]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for which, s, t in (("a_less", a, b), ("not a_less", b, a))]
        pairs = scratch.save(both[0].unionByName(both[1]).distinct(), "pairs")
        labels = merge_labels(labels, scratch.save(_linked(pairs, sets, percent), "links"), scratch)
        break
    return labels


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles (size of its set), component_id (the least doc_id
    that can be reached over links, itself included).

    Words are runs of characters other than space and \\x09-\\x0D, A-Z in lower case. A null or empty text has an
    empty set and no links, and its component_id is its own doc_id. Rows with a null doc_id take part
    and count only for ids if no other row of their component has one. Repeated ids and rows are
    linked like any equal texts. doc_id may be of any type with an order; only doc_id and text are read. Nodes are
    64-bit hashes of sets. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = save(_sets(docs, width), "sets")
    kept = _shared_prefix(docs, width, percent)
    # the row that stands for a node, and whether the table repeats it
    stands = rows.where("n > 0").groupBy("node", "n", F.xxhash64("doc_id").alias("k")).agg(F.count(F.lit(1)).alias("c")).groupBy("node", "n").agg(F.min(F.struct("k", "c")).alias("x"))
    enough = (percent * F.col("n") / 100 / 8).cast("int") + 1  # what two longer prefixes share at least, for the smallest partner
    wanted = stands.join(kept, "node").where(F.col("shared") >= enough).select(F.col("x.k").alias("k"), "node", (F.col("x.c") > 1).alias("many"))
    wanted = scratch.save(wanted, "wanted")
    sets = scratch.save(_node_tokens(docs, wanted, width, wanted.count() <= BROADCAST_ROWS), "node-tokens")
    if not sets.where("many").isEmpty():
        once = sets.where("many").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        sets = scratch.save(sets.where("not many").select("node", "n", "tokens").unionByName(once), "node-tokens")
    labels = save(_components(sets, percent, scratch).where("node <> comp"), "labels")
    scratch.drop()
    named = rows.join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "node", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "node")))
    # components of one row need no look-up; the others are written first, so that Spark can split a large one's join
    least = save(named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("comp", "least", F.lit(True).alias("many")), "least-ids")
    named = named.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "comp", "left")
    return named.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("many"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the least doc_id stays (equal ids: the
    least text hash; equal rows: one). Rows with empty sets all stay, null ids come last. All columns are kept,
    whatever their names; an empty table stays empty."""
    found = save(similar_groups(docs, width, percent), "groups")
    full = found.where("n_shingles > 0")
    id_, hash_ = "_k", "_h"
    while {id_, hash_} & set(docs.columns):
        id_, hash_ = id_ + "_", hash_ + "_"
    each = full.groupBy(F.xxhash64("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.xxhash64("component_id").alias("c")).agg(F.count(F.lit(1)).alias("copies"))
    each = save(each, "copies")
    rest, own = each.where(F.col(id_) != F.col("c")), each.where(F.col(id_) == F.col("c"))  # the id that stays may have several texts
    best = own.join(own.groupBy("c").agg(F.min(hash_).alias("best")), "c").withColumn("out", F.col(hash_) != F.col("best"))
    marked = rest.withColumn("out", F.lit(True)).select(id_, hash_, "out").unionByName(best.where("out or copies > 1").select(id_, hash_, "out"))
    marked = save(marked, "leaving")
    few = marked.count() <= BROADCAST_ROWS
    own = docs.withColumn(id_, F.xxhash64("doc_id")).withColumn(hash_, F.xxhash64("text"))
    side = lambda m: F.broadcast(m) if few else m
    stay = own.join(side(marked.select(id_, hash_)), [id_, hash_], "left_anti")
    repeated = marked.where("not out").select(id_, hash_)
    if not repeated.isEmpty():
        stay = stay.unionByName(own.join(side(repeated), [id_, hash_], "left_semi").dropDuplicates([id_, hash_]))
    return stay.select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).drop("text_hash")


#: All pairs that share a shingle, and all that links reach: fit for small tables alone.
ORACLE_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as sh from d),
t as (select r, len(sh) as n, unnest(sh) as g from s),
o as (select a.r as a, b.r as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o from t a join t b on a.g = b.g and a.r < b.r group by 1, 2),
l as (select a, b from o where 100 * o >= 75 * (na + nb - o)),
e as (select a, b from l union all select b, a from l),
reach(a, b) as (select r, r from s union select reach.a, e.b from reach join e on e.a = reach.b)
select any_value(x.doc_id) as doc_id, any_value(len(x.sh))::bigint as n_shingles, min(y.doc_id) as component_id from reach join s x on x.r = reach.a join s y on y.r = reach.b group by reach.a
"""
