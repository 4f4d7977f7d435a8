import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.helpers import rows
from veriloom.llm import common, exact_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, keep_id string, n int"


def docs(spark, *pairs):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in pairs], DOCS)


# -- exact


def test_exact_ties_nulls_and_case(spark):
    d = docs(spark, (1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (7, "x" * 300_000), (None, "ab"), (None, "only null"))
    got = rows(exact_dedup.exact_dedup(common.docs_of(d)), "doc_id", "keep_id")
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got] == [(1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, True), (None, 2, 3, False), (None, None, 1, True)]
    assert got[0]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_exact_stage_keeps_one_row_and_all_columns(spark):
    d = docs(spark, (1, "a"), (2, "A"), (7, "x"), (7, "x"), (7, "y"))
    kept = exact_dedup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "A"), (7, "x"), (7, "y")]


def test_exact_stage_on_repeated_ids_and_clashing_names(spark):
    schema = "doc_id long, text string, _id int, _digest string, key string, row string, shard int"
    d = spark.createDataFrame([(1, "a", 1, "d", "k", "r", 0), (1, "b", 2, "d", "k", "r", 0), (2, "A", 3, "d", "k", "r", 0), (None, "c", 4, "d", "k", "r", 0), (None, "c", 5, "d", "k", "r", 0), (None, None, 6, "d", "k", "r", 0)], schema)
    for stage in (exact_dedup.keep_one, near_dedup.keep_one):
        kept = stage(d)
        assert kept.columns == d.columns and {r["_digest"] for r in kept.collect()} == {"d"}
        texts = [(r.doc_id, r.text) for r in kept.collect()]
        assert len(texts) == len(set(texts)) == 4 and (1, "b") in texts and (None, "c") in texts and (None, None) in texts


def test_exact_winners_come_from_the_slots(spark, monkeypatch):
    d = common.docs_of(docs(spark, (1, "a"), (2, "b"), (9, "a"), (10, "c")))
    want = rows(exact_dedup.exact_dedup(d), "doc_id")
    assert [(r["keep_id"], r["group_size"]) for r in want] == [(9, 2), (2, 1), (9, 2), (10, 1)]
    table = pa.table({"digest": pa.array([bytes([i]) * 32 for i in range(4)], pa.binary()), "shard": [0] * 4, "locator": [5, 6, 7, 8], "n": [1, 2, 3, 4]})
    index = exact_dedup._build(table)
    asked = pa.table({"digest": pa.array([bytes([2]) * 32, bytes([9]) * 32], pa.binary()), "shard": [0] * 2, "locator": [1, 2], "n": [10, 20]})
    answer = lambda: {r["digest"][0]: (r["keep_id"], r["group_size"]) for r in exact_dedup._look_up(asked, index).to_pylist()}
    assert answer() == {0: (5, 1), 1: (6, 2), 2: (7, 13), 3: (8, 4), 9: (2, 20)}
    monkeypatch.setattr(exact_dedup.MinimalPerfectHash, "slots", lambda self, keys: np.full(len(keys), -1))
    assert exact_dedup._look_up(asked, index).num_rows == 6


def test_exact_large_groups_equal_small_ones(spark, monkeypatch):
    d = common.docs_of(spark.range(600).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id % 50)) AS text"))
    want = rows(exact_dedup.exact_dedup(d), "doc_id")
    monkeypatch.setattr(common, "HEAVY_ROWS", 100)
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 10)
    assert rows(exact_dedup.exact_dedup(d), "doc_id") == want


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(common.docs_of(spark.createDataFrame([], DOCS))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_minimal_perfect_hash(n):
    keys = common.mix(np.arange(n))
    mph = exact_dedup.MinimalPerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(n))


# -- near


def edited(words, k, rng):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def distance(a, b):
    """Edit distance of two lists by bits of whole numbers: shares no code with the operator."""
    if not a or not b:
        return max(len(a), len(b))
    places = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    mask = (1 << len(a)) - 1
    plus, minus, top, score = mask, 0, len(a) - 1, len(a)
    for y in b:
        same = places[y]
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (~(across | plus) & mask), plus & across
        score += (up >> top & 1) - (down >> top & 1)
        up, down = (up << 1 | 1) & mask, (down << 1) & mask
        reach = same | minus
        plus, minus = (down | ~(reach | up)) & mask, up & reach
    return score


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_links(texts):
    """Pairs of different word lists that need at most a fifth of the longer one in edits."""
    seqs = [plain_words(t) for t in texts]
    bags = [Counter(x) for x in seqs]
    for i in range(len(texts)):
        for j in range(i):
            longest = max(len(seqs[i]), len(seqs[j]))
            if seqs[i] == seqs[j] or longest - sum((bags[i] & bags[j]).values()) <= 0.2 * longest and distance(seqs[i], seqs[j]) <= 0.2 * longest:
                yield i, j


def plain_groups(texts):
    """Components of all such pairs, by brute force."""
    group = list(range(len(texts)))
    for i, j in plain_links([t for _, t in texts]):
        a, b = group[i], group[j]
        if a != b:
            group = [min(a, b) if g in (a, b) else g for g in group]
    first = {}
    for (doc, _), g in zip(texts, group, strict=True):
        first[g] = min(first.get(g, doc), doc)
    return {doc: first[g] for (doc, _), g in zip(texts, group, strict=True)}


def test_near_equals_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for base in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(9):
            texts.append((len(texts), " ".join(edited(words, rng.randrange(0, max(2, len(words) // 30)), rng))))
    texts += [(100, ""), (101, None), (102, "one two"), (103, "One, two!"), (104, "one three"), (105, "a " * 20_000)]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(common.docs_of(docs(spark, *texts))).collect()}
    assert got == plain_groups(texts)


def test_near_on_documents_equals_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(common.docs_of(d)).collect()}
    assert got == plain_groups([(r.doc_id, r.text) for r in d.orderBy("doc_id").collect()])


def test_near_short_texts_equal_brute_force(spark):
    rng, texts = random.Random(8), []
    for n in [*[8, 9] * 20, *range(1, 36)]:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [(len(texts), " ".join(words)), (len(texts) + 1, " ".join([*words, "more"])), (len(texts) + 2, " ".join(["and", *words, "yet", "more"]))]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(common.docs_of(docs(spark, *texts))).collect()}
    assert got == plain_groups(texts)


def test_near_links_that_miss_the_leader(spark):
    """A chain in which each text is near its neighbours only, among strangers that share a passage."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    chain, texts = words, []
    for i in range(40):
        texts.append((i, " ".join(chain)))
        chain = edited(chain, 8, rng)
    passage = [f"p{k}" for k in range(60)]
    texts += [(100 + i, " ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(60))])) for i in range(40)]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(common.docs_of(docs(spark, *texts))).collect()}
    want = plain_groups(texts)
    assert want[39] == 0 and want[100] == 100
    assert got == want


def test_near_recall_on_documents(spark):
    """Share of all pairs at edit similarity 0.8 whose texts end in one group, over every document of sf0.01."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in d.collect())
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(common.docs_of(d)).collect()}
    links = list(plain_links([t for _, t in texts]))
    assert len(links) > 90
    assert sum(got[texts[i][0]] == got[texts[j][0]] for i, j in links) / len(links) >= 0.9


def test_near_settles_pairs_once_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [(i, " ".join(edited(base, 30, rng))) for i in range(40)]
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(common.docs_of(docs(spark, *texts))).collect()}
    want = plain_groups(texts)
    assert sum(got[i] == want[i] for i in got) >= 0.9 * len(got)


def test_near_stage_keeps_one_row_of_each_group(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    d = docs(spark, (7, a), (7, a), (7, a + " more"), (7, b), (9, b), (None, b), (8, "x y"), (3, None), (4, ""))
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns
    got = [(r.doc_id, (r.text or "")[:2]) for r in kept.collect()]
    assert len(got) == 4 and (None, "b0") in got and (8, "x ") in got and (3, "") in got
    assert sum(doc == 7 and t == "a0" for doc, t in got) == 1


def test_near_empty_and_null_ids(spark):
    assert near_dedup.near_duplicates(common.docs_of(spark.createDataFrame([], DOCS))).count() == 0
    got = rows(near_dedup.near_duplicates(common.docs_of(docs(spark, (None, "a b c d e f"), (3, "a b c d e f")))), "doc_id")
    assert [(r["doc_id"], r["group_id"], r["kept"]) for r in got] == [(3, None, False), (None, None, True)]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [rng.randrange(4) for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [x for x in a if rng.random() > 0.1]
        want = distance(a, b)
        for most in range(max(0, want - 1), want + 3):
            assert near_dedup.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == (want if most >= want else None)


def test_edit_distance_of_long_texts_is_quick():
    rng = random.Random(4)
    a = np.array([rng.randrange(2_000) for _ in range(20_000)], np.uint64)
    began = time.time()
    assert near_dedup.edit_distance(a, np.concatenate([a[10_000:], a[:10_000]]), 4_000) is None
    assert near_dedup.edit_distance(a, np.delete(a, np.arange(0, 20_000, 200)), 4_000) == 100
    assert time.time() - began < 20


# -- substrings


def plain_substrings(texts):
    split = {i: [w for w in (t or "").replace("\t", " ").split(" ") if w] for i, t in texts}
    first = {}
    for i in sorted(split):
        for p in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][p : p + 13]), i)
    out = {}
    for i, words in split.items():
        gone = set()
        for p in range(len(words) - 12):
            if first[tuple(words[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "é"] if seed == 0 else [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(6)] + [["x"] * 30]
    texts = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        texts.append((i, rng.choice([" ", "  ", " \t"]).join(words)))
    texts += [(100, texts[5][1]), (101, None), (102, ""), (103, "  "), (104, "x " * 40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(common.docs_of(docs(spark, *texts))).collect()}
    assert got == plain_substrings(texts)


def test_substrings_of_repeated_and_null_ids(spark):
    a = " ".join(f"a{i}" for i in range(20))
    got = rows(substring_dedup.substring_dedup(common.docs_of(docs(spark, (1, a), (2, a + " u1"), (2, a + " u1"), (2, "v " + a + " w")))), "doc_id", "n_words")
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in got] == [(1, 20, 0), (2, 21, 20), (2, 21, 20), (2, 22, 20)]
    got = rows(substring_dedup.substring_dedup(common.docs_of(docs(spark, (1, a), (None, a + " u1"), (None, "v1 " + a)))), "doc_id")
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in got] == [(1, 20, 0), (None, 21, 20), (None, 21, 20)]


def test_substrings_of_long_texts(spark):
    long = " ".join(f"w{i % 5_000}" for i in range(200_000))
    texts = [(1, "x " * 100_000), (2, "x " * 100_001), (3, long), (4, "new " + long)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(common.docs_of(docs(spark, *texts))).collect()}
    assert got == {1: (100_000, 0), 2: (100_001, 100_001), 3: (200_000, 0), 4: (200_001, 200_000)}


def test_substrings_empty(spark):
    assert substring_dedup.substring_dedup(common.docs_of(spark.createDataFrame([], DOCS))).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") for _ in range(200)) for _ in range(20)]
    col = pa.array(texts)
    words, starts = common.word_hashes(col)
    anchor = substring_dedup.anchors(words, starts)
    split, seen = [t.split() for t in texts], defaultdict(set)
    for d, w in enumerate(split):
        for p in range(len(w) - 12):
            seen[tuple(w[p : p + 13])].add(int(anchor[starts[d] + p]))
    assert all(len(v) == 1 and 0 not in v for v in seen.values())


def test_word_hashes_agree_with_words():
    col = pa.array(["a b", None, "", "  é\tb\x0b c", "b" * 200 + " " + "b" * 200])
    flat, starts = common.split_words(col)
    hashes, also = common.word_hashes(col)
    assert starts.tolist() == also.tolist()
    named = {}
    for w, h in zip(flat.to_pylist(), hashes.tolist(), strict=True):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def test_stash_and_discard(spark):
    t = common.stash(spark.range(3), "t")
    assert t.count() == 3
    common.discard(t)
