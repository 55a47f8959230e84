"""Shards and slots of the ring against a plain walk around it, document by document."""

import hashlib
import random
import zlib

from waveloom.llm import sharding

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def walk(rows, shards):
    """(doc_id, size, crc, shard, slot) of all rows: bytes are laid on the ring place after place, and poured into the shards."""
    number = lambda text, a, n: int(hashlib.md5(text.encode()).hexdigest()[a : a + n], 16)
    nodes = sorted((number(f"node:{s}:{v}", 0, 12) % sharding.PLACES, s, v) for s in range(shards) for v in range(sharding.NODES))
    laid = []
    for i, text in rows:
        raw = (text or "").encode()
        key = f"key:{'null' if i is None else i}"
        laid.append((number(key, 0, 12) % sharding.PLACES, number(key, 12, 6) % sharding.CELLS, hashlib.md5(key.encode()).hexdigest(), -1 if i is None else i, zlib.crc32(raw), len(raw) + 1))
    laid.sort()
    total = sum(x[5] for x in laid)
    room = [-(-total * (1 + sharding.SLACK) // shards)] * shards
    load = {}
    for x in laid:
        load[x[0]] = load.get(x[0], 0) + x[5]

    def clockwise(place):
        k = next((k for k, n in enumerate(nodes) if n[0] >= place), 0)
        while True:
            yield nodes[k][1]
            k = (k + 1) % len(nodes)

    held = {}
    for place in sorted(load):  # homes first
        s = next(clockwise(place))
        take = min(load[place], room[s])
        room[s] -= take
        held[place] = [(s, take)]
    for place in sorted(load):
        left = load[place] - held[place][0][1]
        way = clockwise(place)
        next(way)
        while left:
            s = next(way)
            take = min(left, room[s])
            if take:
                held[place].append((s, take))
                room[s] -= take
                left -= take
    out, slots, at, last = [], [0] * shards, 0, None
    for place, _, _, i, crc, size in laid:
        at = at if place == last else 0
        last = place
        edge = 0
        for s, take in held[place]:
            if take and edge <= at:
                shard = s
            edge += take
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return out


def test_equals_a_walk(spark):
    r = random.Random(7)
    rows = [(i % 900 if i % 97 else None, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 40)))) for i in range(1200)] + [(5, "same text")] * 300 + [(6, None), (7, ""), (7, "")]
    for shards in (8, 3):
        got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in got) == sorted(walk(rows, shards))
