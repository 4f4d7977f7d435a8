import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from veriloom.llm import decontamination, language, licenses, quality, toxicity, url_filter
from veriloom.llm.common import docs_of, fold_of

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, lang string"


def docs(spark, *texts):
    return docs_of(spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], DOCS))


EDGES = (None, "", "  ", "x" * 200_000, "idiot", "idiot")


def held_out(spark, got, label):
    return got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", label), "doc_id").collect()


# -- toxicity


@pytest.mark.parametrize("text", ["You 1D10T!", "an іdіоt", "i\u200bdiot", "IDIOT", "ｉｄｉｏｔ", "$tupid"])
def test_folding(text):
    assert " idiot " in toxicity.fold(text) or " stupid " in toxicity.fold(text)


@pytest.mark.parametrize("text, word", [("tr@$h", "trash"), ("l0$er", "loser"), ("tr4$h", "trash"), ("1d107", "idiot"), ("p@7h371c", "pathetic"), ("wow 5!$tup1d!!", "stupid")])
def test_folding_runs_of_substitutes(text, word):
    assert f" {word} " in toxicity.fold(text)


def test_folding_equals_plain_pattern():
    plain = re.compile(r"[^\W_]*(?:[^\W\d_][0-9@$!]+|[0-9@$]+)(?=[^\W\d_])[^\W_]*(?:[0-9@$!]+[^\W_]+)*")
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("aab059@$!!_ .é²٣") for _ in range(rng.randrange(12)))
        want = plain.sub(lambda m: "".join(toxicity.SUBSTITUTES.get(c, c) for c in m[0]), text)
        assert toxicity.fold(text).split() == re.findall(r"[^\W_]+", want), text


def test_folding_takes_linear_time():
    began = time.time()
    for part in ("a", "1", "a1", "!", "1!", "a!", "@a", "1é!"):
        toxicity.fold(part * 200_000)
    assert time.time() - began < 20


def test_folding_leaves_numbers_and_noise():
    assert toxicity.fold("In 2024, 35% of$$$ it.") == " in 2024 35 of it "


def test_exceptions():
    auto = toxicity.automaton(toxicity.ToxicityModel(dict(toxicity.SEED), ()))
    assert toxicity.matches(toxicity.fold("Use the trash can."), auto) == []
    assert len(toxicity.matches(toxicity.fold("You are trash."), auto)) == 1


def plain_matches(folded, model):
    """(start, weight) by looking for every entry at every place."""
    at = lambda what: [p for p in range(len(folded)) if folded.startswith(what, p)]
    spared = [(p, p + len(x) - 1) for x in model.exceptions for p in at(x)]
    best = {}
    for entry, weight in model.entries.items():
        for p in at(entry):
            best[p] = max(best.get(p, 0), weight)
    return sorted((p, w) for p, w in best.items() if not any(a <= p < b for a, b in spared))


def test_matches_equal_plain_scan():
    model = toxicity.ToxicityModel(toxicity.SEED | {" tras": 1.0, " idi": 5.0, " die ": 0.5}, ())
    auto, rng = toxicity.automaton(model), random.Random(7)
    words = ["trash", "can", "idiot", "proof", "die", "cast", "tool", "and", "pig", "guinea", "rat", "race", "lab", "other", "sore", "loser", "rule", "clown", "fish"]
    for _ in range(300):
        folded = f" {' '.join(rng.choice(words) for _ in range(rng.randrange(12)))} "
        assert sorted(toxicity.matches(folded, auto)) == plain_matches(folded, model)


def test_matches_take_linear_time():
    auto = toxicity.automaton(toxicity.ToxicityModel(dict(toxicity.SEED), ()))
    began = time.time()
    assert len(toxicity.matches(toxicity.fold("trash can idiot " * 200_000), auto)) == 200_000
    assert time.time() - began < 20


def test_toxicity_null_ids(spark):
    model = toxicity.ToxicityModel(dict(toxicity.SEED), (1.0, 0.0, 1.0, -3.0))
    got = toxicity.score(spark.createDataFrame([(None, "you idiot"), (None, None)], "doc_id long, text string"), model).collect()
    assert [r.doc_id for r in got] == [None, None]


def test_toxicity_held_out_and_edges(spark):
    got = toxicity.op4_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    seen = held_out(spark, got, "toxic")
    assert sum((r.predicted == r.toxic) for r in seen) / len(seen) > 0.95
    model = toxicity.ToxicityModel(dict(toxicity.SEED), (1.0, 0.0, 1.0, -3.0))
    scored = rows(toxicity.score(docs(spark, *EDGES), model), "doc_id")
    assert scored[0]["score"] == scored[1]["score"] == scored[2]["score"] < 0.5 < scored[4]["score"] == scored[5]["score"]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


# -- quality


def test_quality_held_out_and_edges(spark):
    seen = held_out(spark, quality.op5_quality(spark, SF), "quality")
    assert sum((r.predicted == r.quality) for r in seen) / len(seen) > 0.9
    none = spark.createDataFrame([], "doc_id long, y int")
    model = quality.train(docs(spark, *EDGES), none)
    assert {round(r.score, 6) for r in quality.score(docs(spark, *EDGES), model).collect()} == {0.3}
    assert quality.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def labelled_texts(n):
    """(text, y) of good and bad texts that no weights tell apart wholly."""
    rng = random.Random(11)
    words = ["some", "Word", "of", "a", "TEXT.", "here", "there.", "$$", "!!", "|", "12"]
    for _ in range(n):
        y = int(rng.random() < 0.7)
        yield " ".join(rng.choice(words[: 8 if y and rng.random() < 0.8 else 11]) for _ in range(rng.randrange(1, 9))), y


def plain_pair_weights(x, y):
    """Weights by Newton's method over every pair of a good and a bad row, one difference each."""
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6)
    good, bad = z[y == 1], z[y == 0]
    diff = (good[:, None] - bad[None]).reshape(-1, z.shape[1])
    weight, w = 24 * min(len(good), len(bad)) / len(diff), np.zeros(z.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(diff @ w))
        w -= np.linalg.solve(weight * (diff.T * (q * (1 - q))) @ diff + np.eye(len(w)), w - weight * diff.T @ q)
    return z, w


def test_quality_weights_are_those_of_all_pairs(spark):
    texts, y = zip(*labelled_texts(400), strict=True)
    model = quality.train(docs(spark, *texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, y int"))
    y = np.array(y)
    z, w = plain_pair_weights(np.array([quality.features(t.encode()) for t in texts]), y)
    assert np.abs(np.array(model.weights) - w).max() < 1e-3 * np.abs(w).max()
    assert model.cut == pytest.approx(np.quantile(z @ w, (y == 0).mean()), abs=1e-3)


def test_quality_learns_from_every_labelled_row(spark, tmp_path):
    # more than 20,000 of them in the training folds
    texts, y = zip(*labelled_texts(27_000), strict=True)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fitted(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    own = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(y))])
    x, y = np.array([quality.features(t.encode()) for t in texts])[own], np.array(y)[own]
    assert len(y) > 20_000
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-9) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6), rtol=1e-9)
    s = quality.strengths(x, np.array(model.mean), np.array(model.scale), np.array(model.weights))
    assert model.cut == pytest.approx(np.quantile(s, (y == 0).mean()), abs=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.93, 1.0])
def test_quality_quantile_equals_numpy(spark, q):
    rng = random.Random(5)
    values = [rng.choice([0.0, -0.0, 1e-300, -3.5, rng.gauss(0, 1), rng.gauss(0, 1e6)]) for _ in range(301)]
    x = spark.createDataFrame([([v, *[0.0] * (quality.N_FEATURES - 1)], 1) for v in values], "x array<double>, y int").repartition(3)
    assert quality.quantile(x, lambda x: x[:, 0], len(values), q) == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quality_of_equal_texts_with_both_labels(spark):
    d = docs(spark, *["the same text"] * 6)
    model = quality.train(d, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, y int"))
    assert {round(r.score, 6) for r in quality.score(d, model).collect()} == {0.3}


# -- language


def test_language_held_out_and_edges(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    seen = language.op8_language(spark, SF).where("held_out").join(d, "doc_id").collect()
    assert sum(r.lang_pred == r.truth for r in seen) / len(seen) > 0.97
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet").where(fold_of(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    got = rows(language.predict(docs(spark, None, "", "12 !", "a", "the and of", "the and of"), model), "doc_id")
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and [r["score"] for r in got[:3]] == [0] * 3
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "en"
    nothing = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert rows(language.predict(docs(spark, "abc"), nothing), "doc_id")[0]["lang_pred"] == "und"


def plain_cosines(text, model):
    """Cosines with the prototypes, trigram by trigram."""
    letters = [0, *(ord(c) if c.isalpha() else 0 for c in (text or "").lower()), 0]
    letters = [c for i, c in enumerate(letters) if c or not i or letters[i - 1]]
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        v = [language.letter_vectors(np.array([x]))[0].astype(float) for x in (a, b, c)]
        total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2] if a or b or c else 0
    return (model.prototypes @ total) / max(np.linalg.norm(total), 1e-9)


def test_language_equals_plain_cosine(spark):
    rng = np.random.default_rng(3)
    proto = rng.standard_normal((3, language.DIMENSIONS))
    model = language.LanguageModel(("a", "b", "c"), (proto / np.linalg.norm(proto, axis=1, keepdims=True)).astype(np.float32))
    texts = ["The quick brown fox", "Быстрая лиса", "語言識別測試", "a b", "x\0y zz", "\U00032000ab\U0002f800 ok", "é" * 50, " lead", "tail 123 end"]
    got = rows(language.predict(docs(spark, *texts), model), "doc_id")
    for r, t in zip(got, texts, strict=True):
        want = plain_cosines(t, model)
        assert r["score"] == pytest.approx(max(0, want.max()), abs=1e-4)
        assert r["lang_pred"] in [n for n, w in zip(model.names, want, strict=True) if w > want.max() - 1e-4]


def test_language_letters_beyond_the_first_planes(spark):
    letters = language.letter_vectors(np.array([0x410, 0x490, 0x32000, 0x61]))
    assert np.abs(letters.astype(float) @ letters.T / language.DIMENSIONS - np.eye(4)).max() < 0.12
    model = language.LanguageModel(("a",), np.ones((1, language.DIMENSIONS), np.float32))
    got = rows(language.predict(docs(spark, chr(0x32000 - 0x1000), "\U000323b0\U000323b1\U000323b2"), model), "doc_id")
    assert got[1]["lang_pred"] == ("a" if chr(0x323B0).isalpha() else "und")


def test_language_of_long_texts_and_null_ids(spark):
    rng = random.Random(1)
    long = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(300_000))
    unit, some = language.profiles([long, None, "ab"])
    assert some.tolist() == [True, False, True] and np.linalg.norm(unit[0]) == pytest.approx(1, abs=1e-3)
    model = language.LanguageModel(("a",), np.ones((1, language.DIMENSIONS), np.float32))
    got = language.predict(spark.createDataFrame([(None, "abc"), (None, "abc")], "doc_id long, text string"), model).collect()
    assert [r.doc_id for r in got] == [None, None] and got[0].score == got[1].score


# -- urls


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_equal_plain(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "http://A.ORG", "http://a.org/x?y#z", "https://sub.Example.org/en/12?q", "http://example.org/es/", "http://x.com/de/a", "http://com/fr/", "http://notorg/", "a://b?c://d/e"]
    got = rows(url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    for r, u in zip(got, urls, strict=True):
        host, path, rule = plain_rule(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == url_filter.RULES[rule])


def test_url_trees_on_held_out_urls(spark):
    """Urls that a rule decides, learned from four fifths of them and judged on the rest."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    ruled = sorted((r.url, r.verdict == "block") for r in url_filter.url_filter(pages).where("rule IS NOT NULL").join(pages, "page_id").select("url", "verdict").distinct().collect())
    train, test = [x for i, x in enumerate(ruled) if i % 5], ruled[::5]
    model = url_filter.train([u for u, _ in train], np.array([int(v) for _, v in train]))
    assert ((model.probability([u for u, _ in test]) >= 0.5) == np.array([v for _, v in test])).mean() > 0.9


def test_url_filter_null_ids_repeats_and_long_urls(spark):
    urls = [(None, "http://a.org/x"), (None, None), (1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://b.net/" + "y" * 200_000)]
    got = url_filter.url_filter(spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, rule string")).collect()
    assert len(got) == 5 and sum(r.page_id is None for r in got) == 2
    assert len({(r.rule, r.verdict) for r in got if r.page_id == 1}) == 1


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = url_filter.boost(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_url_filter_empty(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


# -- licenses


def plain_base(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) >= 128 else " " for c in words).split()
    places = sorted((i, x) for p, x in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.decode().split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licenses_equal_plain(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", "CC BY CC-BY cc by", "the MIT\nLicense, MIT License", "GNU General Public Licensee", "gnu GENERAL public license v3", "É mit license"]
    got = rows(licenses.license_scan(docs(spark, *texts)), "doc_id")
    for r, t in zip(got, texts, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def plain_detections(text):
    """Every rule at every place, without gate or automaton, and suppression by comparing all detections."""
    words = re.sub("[^a-z0-9\x80-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split()
    joined = f" {' '.join(words)} ".encode() if words else b""
    hits = [(m.start(), m.end(), -r.priority, i) for i, r in enumerate(licenses.rules()) for m in re.finditer(rf" (?:{r.pattern})(?= )".encode(), joined)]
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and (y[1] - y[0] > x[1] - x[0] or x[2:] > y[2:])
    hits = sorted(x for x in hits if not any(inside(x, y) for y in hits))
    kept = []
    for x in hits:
        while kept and kept[-1][1] > x[0] and kept[-1][2] > x[2]:
            kept.pop()
        if not kept or kept[-1][1] <= x[0]:
            kept.append(x)
    return [(joined.count(b" ", 0, a), joined.count(b" ", 0, b), licenses.rules()[i].name) for a, b, _, i in kept]


def test_license_detections_equal_plain(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if re.search("(?i)licen|gnu|cc.by|rights", r.text or "")][:150]
    plain = re.compile(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??|\[(.)[^\]]*\]\??|(.)\?")
    spelled = []
    for rule in licenses.rules():  # a text for each rule: its first alternatives
        pattern = rule.pattern
        while (simple := plain.sub(lambda m: m[1] or m[2] or (m[3] if m[3] else ""), pattern)) != pattern:
            pattern = simple
        spelled.append(pattern)
    rng = random.Random(6)
    texts += spelled + [" ".join(rng.choice(spelled) for _ in range(8)) for _ in range(300)]
    found = 0
    for t in texts:
        got = [(a, b, r.name) for a, b, r in licenses.scan(t.encode())["kept"]]
        assert got == plain_detections(t), t
        found += len(got)
    assert found > 2_000


def test_license_rules():
    assert len(licenses.rules()) == len({r.name for r in licenses.rules()}) > 200
    found = lambda t: [r.name for _, _, r in licenses.scan(t)["kept"]]
    assert found(b"Licensed under the Apache License, Version 2.0 (the License)") == ["apache-grant"]
    assert found(b"GNU Lesser General Public License") == ["lgpl-name"]
    assert found(b"SPDX-License-Identifier: MIT") == ["spdx-mit"]
    labels = lambda t: {r.label for _, _, r in licenses.scan(t)["kept"]}
    assert [labels(t) for t in (b"GPLv3", b"LGPL", b"MPL 2.0", b"EPL 1.0", b"CC-BY-NC-SA 4.0")] == [{"gpl"}, {"lgpl"}, {"mpl"}, {"epl"}, {"cc-by-nc-sa"}]
    assert found(b"nothing here") == []


def test_license_scan_takes_linear_time(spark):
    began = time.time()
    assert licenses.scan(b"mit license " * 400_000)["n_words"] == 800_000
    assert time.time() - began < 30
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = rows(licenses.license_scan(spark.createDataFrame([(None, "MIT license"), (1, "x"), (1, "x")], "doc_id long, text string")), "doc_id")
    assert [(r["doc_id"], r["labels"], r["score"]) for r in got] == [(1, "", 0.0), (1, "", 0.0), (None, "mit", 0.8)]


# -- decontamination


def test_decontamination_equals_plain(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 20)))) for i in range(4)] + [(51, None)]
    texts, want = [], set()
    for d in range(24):
        text = " ".join(word() for _ in range(12))
        if d % 2:
            i = rng.randrange(4)
            copy = list(items[i][1])
            for _ in range(rng.randrange(0, int(len(copy) * decontamination.EDIT_RATE))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice(["", "z", "zz"])
            if d % 4 == 1:
                copy = "".join(copy).upper().replace(" ", ", ")
            text = f"{text}. {''.join(copy)}! {text}"
        texts.append(text)

    def best(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
            row = new
        return min(row)

    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    index = decontamination.build([x for x in items if x[1]])
    for d, t in enumerate(texts):
        for k, i in enumerate(index.ids):
            if best("".join(map(chr, index.chars[k])), fold(t)) <= index.edits[k]:
                want.add((d, i))
    got = decontamination.leaks(docs(spark, *texts, None, ""), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) >= 8
    kept = decontamination.without_leaks(docs(spark, *texts, None, ""), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(26)) - {d for d, _ in want}


@pytest.mark.parametrize("place", [3, 5, 8, 85, 88, 90])
def test_decontamination_edits_near_ends(place):
    rng = random.Random(place)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    for offset in range(24):
        item = letters(93)
        index = decontamination.build([(1, item)])
        assert index.edits.tolist() == [7]
        copy = f"{item[:40]}zzzzzz{item[46:]}"  # six edits; one more near an end, which moves the rest by a diagonal
        for edited in (f"{copy[:place]}z{copy[place:]}", copy[:place] + copy[place + 1 :]):
            for tail in ("", letters(30)):
                assert [g[:2] for g in decontamination.find([letters(offset) + edited + tail], index)] == [(0, 0)], (offset, edited)


def test_decontamination_of_short_items_and_repeats(spark):
    items = [(1, "Tiny"), (None, "ab c"), (3, "long enough item"), (3, "long enough item")]
    texts = ["a tiny dog, tiny cat", "tinyish", "ab-c", "xab c", None, "Long enough item", "TINY"]
    got = decontamination.leaks(docs(spark, *texts), spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, start string"))
    assert sorted((r.doc_id, r.item_id or 0, r.start, r.end, r.edits) for r in got.collect()) == [(0, 1, 2, 6, 0), (2, 0, 0, 4, 0), (5, 3, 0, 16, 0), (5, 3, 0, 16, 0), (6, 1, 0, 4, 0)]
    repeated = spark.createDataFrame([(None, "x tiny", 1), (None, "fine", 2), (5, "fine", 3), (5, "fine", 4)], "doc_id long, text string, edits int")
    kept = decontamination.without_leaks(repeated, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == repeated.columns and sorted(r.edits for r in kept.collect()) == [2, 3, 4]


def test_decontamination_of_one_repeated_letter():
    index = decontamination.build([(1, "a" * 400)])
    began = time.time()
    assert [g[:2] for g in decontamination.find(["a" * 60_000, "b" * 1_000, "a" * 399], index)] == [(0, 0), (2, 0)]
    assert time.time() - began < 60


def test_decontamination_blocks_and_empty(spark, monkeypatch):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in decontamination.leaks(docs_of(d), b).collect())
    assert whole and all(r[4] == 0 for r in whole)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (2000,))
    assert sorted(tuple(r) for r in decontamination.leaks(docs_of(d), b).collect()) == whole
    assert decontamination.leaks(docs_of(d), b.limit(0)).count() == 0
    assert decontamination.leaks(docs_of(d).limit(0), b).count() == 0
