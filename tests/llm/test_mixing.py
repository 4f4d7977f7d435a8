import hashlib
import heapq
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tests.helpers import rows
from veriloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, place int, taken string"


def one_by_one(weight, most, seats):
    """Seats dealt one at a time to the highest quotient."""
    out = [0] * len(weight)
    heap = [(-float(w), i) for i, w in enumerate(weight) if w > 0 and most[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-float(weight[i]) / (2 * out[i] + 1), i))
    return out


def cases():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 12)
        weight = [rng.choice([0, 1, 1, 2, 3.5, 10, 10, 700, 1e6 * rng.random()]) for _ in range(n)]
        most = [rng.choice([0, 1, 2, 5, 40, 1_000]) for _ in range(n)]
        yield weight, most, rng.randrange(0, 60)


def test_apportion_equals_dealing_seat_by_seat():
    for weight, most, seats in cases():
        assert mixing.apportion(np.array(weight), np.array(most), seats).tolist() == one_by_one(weight, most, seats), (weight, most, seats)


def test_apportioning_a_table_equals_dealing_seat_by_seat(spark):
    some = [c for c in cases() if any(w and m for w, m in zip(c[0], c[1], strict=True))][:4] + [([10.0] * 9, [5] * 9, 13), ([1e9, *[1.0] * 30], [10**6, *[1] * 30], 1_000)]
    for weight, most, seats in some:
        items = spark.createDataFrame([(i, float(w), m) for i, (w, m) in enumerate(zip(weight, most, strict=True))], "place long, weight double, most long")
        assert [r["seats"] for r in rows(mixing.apportion_table(items, seats, max(sum(weight), 1) / 2 / max(seats, 1)), "place")] == one_by_one(weight, most, seats)


def plainly(pairs, block, shard_words, weights=(5, 2, 1)):
    """The mix with every block and seat listed, and exact targets."""
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in pairs]
    sources = sorted({s for _, s, _ in pairs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(w for (_, x, _), w in zip(pairs, words, strict=True) if x == s) for s in sources}
    count = {s: sum(x == s for _, x, _ in pairs) for s in sources}
    share, total = {s: weights[i % 3] for i, s in enumerate(sources)}, sum(words)
    target, left = {}, Fraction(3 * total, 2)
    while open_ := [s for s in sources if s not in target]:
        each = left / sum(share[s] for s in open_)
        above = [s for s in open_ if share[s] * each > 2 * size[s]]
        for s in above or open_:
            target[s] = Fraction(2 * size[s]) if above else share[s] * each
        left -= sum(target[s] for s in above)
    shards = defaultdict(list)
    for i, ((doc, s, t), w) in enumerate(zip(pairs, words, strict=True)):
        h = hashlib.sha256(f"42:{'' if doc is None else doc}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        shards[sources.index(s), int(h[:15], 16) % -(-(size[s] + count[s]) // shard_words)].append((h, w, i))
    blocks = {k: -(-sum(w for _, w, _ in v) // block) for k, v in shards.items()}
    most = [2 * sum(n for (p, _), n in blocks.items() if p == place) for place in range(len(sources))]
    seats = one_by_one([float(target[s]) for s in sources], most, (3 * total + block) // (2 * block))
    taken = [0] * len(pairs)
    for place in range(len(sources)):
        own = sorted(k for k in shards if k[0] == place)
        quotas = one_by_one([sum(w for _, w, _ in shards[k]) for k in own], [2 * blocks[k] for k in own], seats[place])
        for k, quota in zip(own, quotas, strict=True):
            n = blocks[k]
            order = sorted(range(n), key=lambda b, k=k: hashlib.sha256(f"42:{k[0]}:{k[1]}:{b}".encode()).hexdigest())
            times = {b: quota // n + (r < quota % n) for r, b in enumerate(order)}
            at = 0
            for _, w, i in sorted(shards[k]):
                taken[i] += sum(times[x // block] for x in range(at, at + w))
                at += w
    return [(doc, w, size[s], float(target[s]), x) for (doc, s, _), w, x in zip(pairs, words, taken, strict=True)]


def corpus():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    pairs = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "ä", "Z", "", None, "zz"]), text(rng.randrange(0, 60))) for i in range(300)]
    return [*pairs, (900, "a", None), (901, "tiny", "one"), (902, "nothing", "  "), (903, None, text(3_000)), (None, "b", "null id"), (None, "hot", "null id too"), (7, "b", "twice seven"), (904, "hot", "x\x0by\xa0z\x1c")]


@pytest.mark.parametrize(("block", "shard_words"), [(16, 262_144), (4, 400), (1, 90)])
def test_mix_equals_plain_version(spark, block, shard_words):
    pairs = corpus()
    docs = spark.createDataFrame([(*p, "clash", 1, "clash") for p in pairs], SCHEMA)
    got = rows(mixing.mix(docs, block=block, shard_words=shard_words))
    key = lambda r: (r[0] is None, *((x or 0) for x in r))
    have, want = (sorted(x, key=key) for x in ([(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got], plainly(pairs, block, shard_words)))
    assert [(a, b, c, pytest.approx(d), e) for a, b, c, d, e in want] == have
    for r in got:
        assert sum((s["stop"] - s["start"]) * s["times"] for s in r["spans"]) == r["taken"] <= 2 * r["size"]
        assert all(0 <= s["start"] < s["stop"] <= r["size"] for s in r["spans"])


def test_repeats_empty_tables_and_reruns(spark):
    docs = spark.createDataFrame([(1, "s", "a b c", "", 0, ""), (1, "s", "a b c", "", 0, ""), (1, "s", "a b c", "", 0, "")], SCHEMA)
    first, again = (rows(mixing.mix(docs, block=1), "taken") for _ in range(2))
    assert first == again and sum(r["taken"] for r in first) == 14 and {r["target"] for r in first} == {13.5}
    assert mixing.mix(docs.limit(0)).count() == 0
    silent = spark.createDataFrame([(1, "s", None, "", 0, ""), (2, None, " ", "", 0, "")], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(silent).collect()] == [(0, 0.0, 0)] * 2


def test_targets_are_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    by = defaultdict(list)
    for r in mixing.mix(docs, spans=False).collect():
        by[r["source_size"], r["target"]].append(r["taken"])
    assert all(abs(sum(x) - target) <= 3 * mixing.BLOCK_WORDS for (_, target), x in by.items())
