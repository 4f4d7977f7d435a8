import random
import re

import pytest

from veriloom.functions import text as T
from veriloom.operators import boundaries as B
from veriloom.operators.segment import segment_documents
from veriloom.operators.sentences import sentences


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Smith paid 3.5 million, e.g. for boats. He left.", ["Dr. Smith paid 3.5 million, e.g. for boats.", "He left."]),
        ("So did I. He left.", ["So did I.", "He left."]),
        ("They came from the U.S. The end.", ["They came from the U.S.", "The end."]),
        ('J. R. Marsh said so. "Really?" She asked! Yes', ["J. R. Marsh said so.", '"Really?"', "She asked!", "Yes"]),
        ("Wait... what? No.", ["Wait... what?", "No."]),
        ("One.\nDr. \nTwo", ["One.", "Dr.", "Two"]),
        ("v1.2.3 is out. See a.b", ["v1.2.3 is out.", "See a.b"]),
        ("... ?!", []),
        (None, []),
    ],
)
def test_sentences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.sentences(df.t)).first()[0] == df.select(T.sentences_by(df.t)).first()[0] == want


def test_both_ways_of_splitting_agree(spark):
    rng = random.Random(11)
    parts = ["Dr.", "e.g.", "U.S.", "etc.", "J.", "I.", "i.", "x", "The", "the", "Marsh", "é", "É", "'The", '"marsh', "(the", "...", "a..", "b...'", "?", "!", "no.", "No.)", "end.", "end.'", "\n", "\t", "", "3.", "St.\r", "\x0b"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(6_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r for r in df.select("t", T.sentences(df.t).alias("x"), T.sentences_by(df.t).alias("y")).collect() if r.x != r.y] == []

SHORT = ("capt", "dist", "n.b", "brig")
STARTS = ("Harbours", "Nobody", "Ships")


def labelled(seed, n):
    """Texts with the offsets at which their sentences end."""
    rng = random.Random(seed)
    words = ["rope", "tide", "sailed", "anchor", "slowly", "Skerry", "Marsh", "north", "crew", "storm", "paid", "mast", "under", "heavy", "skies"]
    out = []
    for _ in range(n):
        text, ends = "", []
        for _ in range(rng.randrange(2, 7)):
            sentence = [rng.choice(STARTS) if rng.random() < 0.7 else rng.choice(["Tide", "Crew", "Marsh"])]
            for _ in range(rng.randrange(4, 9)):
                sentence.append(rng.choice(words) if rng.random() < 0.75 else rng.choice(SHORT) + ". " + rng.choice(["Skerry", "Marsh", "Odo", "4.5"]))
            sentence.append(rng.choice(words) if rng.random() < 0.9 else rng.choice(SHORT))
            text += (" " if text else "") + " ".join(sentence) + ("." if sentence[-1] in SHORT else rng.choice(".....!?"))
            ends.append(len(text))
        out.append((text, ends))
    return out


def ends_of(text, cut):
    at, out = 0, []
    for s in cut:
        at = text.index(s, at) + len(s)
        out.append(at)
    return set(out)


def test_learned_words_and_boundary_precision_and_recall(spark):
    training, held = labelled(1, 600), labelled(2, 300)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(training)], "doc_id long, text string")
    short, starting = B.learn(docs)
    assert {r.word for r in short.collect()} == set(SHORT)
    assert {r.word for r in starting.collect()} >= {w.lower() for w in STARTS}
    new = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    scores = {}
    for name, learned in (("learned", (short, starting)), ("fixed", None)):
        cut = {}
        for r in sorted(sentences(new, learned).collect(), key=lambda r: (r.doc_id, r.sentence_id)):
            cut.setdefault(r.doc_id, []).append(r.text)
        found = {(i, e) for i, (t, _) in enumerate(held) for e in ends_of(t, cut[i])}
        right = {(i, e) for i, (_, ends) in enumerate(held) for e in ends}
        scores[name] = (len(found & right) / len(found), len(found & right) / len(right))
    print(scores)
    assert scores["learned"][0] >= 0.97 and scores["learned"][1] >= 0.97 and scores["learned"][0] > scores["fixed"][0] + 0.1
    whole = segment_documents(new, least=50, learned=(short, starting)).collect()
    by_line = {}
    for r in sentences(new, (short, starting)).collect():
        by_line[r.doc_id] = by_line.get(r.doc_id, 0) + 1
    assert {r.doc_id: sum(len(s.sentences) for s in whole if s.doc_id == r.doc_id) for r in whole} == by_line


def test_scores_equal_the_formulas(spark):
    import math

    texts = [t for t, _ in labelled(3, 80)]
    tokens = [re.sub(r"^[\"'“‘(\[]+|[\"'”’)\],;:!?]+$", "", w) for t in texts for w in t.split()]
    counts = {}
    for t in tokens:
        word = (t[:-1] if t.endswith(".") else t).lower()
        if re.search("[a-z]", word) and not re.search("[0-9]", word):
            counts.setdefault(word, [0, 0])[not t.endswith(".")] += 1
    share = sum(c[0] for c in counts.values()) / sum(map(sum, counts.values()))
    want = {}
    for word, (a, b) in counts.items():
        letters = len(word.replace(".", ""))
        score = 2 * (a * math.log(0.99) + b * math.log(0.01) - a * math.log(share) - b * math.log(1 - share)) * math.exp(-letters) * (word.count(".") + 1) * letters**-b
        if a and score >= 0.3:
            want[word] = score
    got = B.abbreviations(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.word: r.score for r in got.collect()} == pytest.approx(want)


def test_nothing_to_learn(spark):
    for texts in ([], [None], [""], ["no stops here"], ["..."]):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        short, starting = B.learn(docs)
        assert short.count() == starting.count() == 0
        assert [r.text for r in sentences(docs, (short, starting)).collect()] == [t for t in texts if t and t != "..."]
