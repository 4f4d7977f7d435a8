import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tests.helpers import rows
from veriloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int, part string, words int"
KEY = ("depth", "conv_id")


def rebuilt(turns):
    own = defaultdict(list)
    name = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", name(role or "", text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def plainly(turns):
    """The trie with every node's members listed."""
    convs = rebuilt(turns)
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    figures = {}
    for path in sorted(members, key=len, reverse=True):
        below = [figures[x] for x in children[path]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        figures[path] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[path]) - 1) * words)
    ends = {p: ",".join(str(c) for c in m if len(convs[c]) == len(p)) for p, m in members.items()}
    out = [
        {"conv_id": m[0], "depth": len(p), "parent_conv_id": members[p[:-1]][0] if p else None, "n_convs": len(m), "n_children": len(children[p]), "n_leaves": figures[p][0], "saved_tokens": figures[p][1], "ends_sha256": hashlib.sha256(ends[p].encode()).hexdigest()}
        for p, m in members.items()
    ]
    return sorted(out, key=lambda r: tuple(r[k] for k in KEY))


def trie(spark, tmp_path_factory, turns):
    where = tmp_path_factory.mktemp("trie")
    spark.createDataFrame([(*t, "clash", 1, "clash", 1) for t in turns], SCHEMA).write.parquet(f"{where}/conversations.parquet")
    return rows(prefix_trie.op12_prefix_trie(spark, str(where)), *KEY)


def conversations(seed):
    rng = random.Random(seed)
    turns = []
    for c in [*range(70), 100, 101, 119, 145, -1, -2, -20, -21, 10**15]:
        if c == 23:
            continue
        say = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "a", "b c", "a  b\n", "é \x1c"]))
        n = rng.choice([1, 1, 2, 3, 4, 6]) if c != 40 else 300
        turns += [(c, i if rng.random() < 0.9 else rng.choice([None, i, 0]), *say()) for i in range(n)]
    turns += [(None, 0, "user", "of none"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "bot", "tie")]
    turns += [(c, i, "user", f"same {i}") for c in range(200, 260) for i in range(5)]  # a family of copies
    turns += [(c, i, "user", f"long {i}") for c in (300, 320, 340) for i in range(120)]
    rng.shuffle(turns)
    return turns


def test_trie_equals_plain_version(spark, tmp_path_factory):
    turns = conversations(1)
    got = trie(spark, tmp_path_factory, turns)
    assert got == plainly(turns)
    assert max(r["n_convs"] for r in got if r["depth"] == 120) == 3 and any(r["depth"] == 0 and r["n_convs"] > 100 for r in got)


def test_small_blocks_fans_and_turnless_conversations(spark, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_CHARS", 5)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    # conversations whose own turns all give way to those of a first one that isn't there
    lost = [c for c in range(1_000, 1_100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:4]
    turns = conversations(2) + [(c, 0, "user", "gone") for c in lost if not any(t[0] == c - c % 20 for t in conversations(2))]
    assert trie(spark, tmp_path_factory, turns) == plainly(turns)
    only = [(lost[0], 0, "user", "gone")]
    assert trie(spark, tmp_path_factory, only) == plainly(only) and len(plainly(only)) == 1


def test_empty_table(spark, tmp_path_factory):
    assert trie(spark, tmp_path_factory, []) == [] and trie(spark, tmp_path_factory, [(None, 1, "user", "x")]) == []


def test_names_go_on_over_batches_and_ranges(spark):
    turns = [(c, d, bytes(16) if not d else hashlib.sha256(b"%d" % (d % 7)).digest()[:16], d == 40) for c in (1, 2) for d in range(41)]
    cols = lambda part: {"conv_id": [t[0] for t in part], "depth": [t[1] for t in part], "turn": [t[2] for t in part], "words": [0] * len(part), "last": [t[3] for t in part], "part": [0] * len(part)}
    names = lambda *cuts: [(r["a"], r["b"]) for out in prefix_trie._running(iter([pa.RecordBatch.from_pydict(cols(turns[i:j])) for i, j in zip((0, *cuts), (*cuts, 82), strict=True)])) for r in out.to_pylist()]
    whole = names()
    assert whole == names(1, 5, 41, 60) == names(*range(1, 82)) and whole[:41] == whole[41:] and len(set(whole)) == 41
    table = spark.createDataFrame([(c, d, bytearray(t), 0, last) for c, d, t, last in turns], "conv_id long, depth long, turn binary, words long, last boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = rows(prefix_trie.named_prefixes(table), "conv_id", "depth")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["part"] for r in got}) > 2 and [(r["a"], r["b"]) for r in got] == whole
    assert all((r["up_a"], r["up_b"], r["up_depth"]) == ((*whole[i - 1], r["depth"] - 1) if r["depth"] else (None, None, None)) for i, r in enumerate(got))
    assert np.all(np.array(whole) >= 0)
