"""Finding verbs, modals and numbers with a sequence tagger: counts by Spark, decoding by Viterbi in Arrow batches.

The model is a hidden Markov model: how often a tag follows another, how often a tag gives a word, and, for words that
training didn't show, how often it gives an ending and a shape.  A sentence asserts something if its best tags hold a
verb, a modal or a number.  Letters mostly in capitals are read in small ones, since shapes would mislead there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions import text as T

#: N nouns and names, R pronouns, V verbs, M modals, C numbers, A adjectives and adverbs, F articles, prepositions and conjunctions.
TAGS = "NRVMCAF"
WORD = r"[A-Za-z]+(?:['’-][A-Za-z]+)*|[0-9][0-9.,]*%?"
ASSERTS = "VMC"
#: The labelled sentences, written for this library; words carry their tag.
LABELLED = """
The_F ferry_N left_V the_F harbour_N at_F noon_N | Revenue_N grew_V twelve_C percent_N | She_R will_M sign_V the_F lease_N tomorrow_A | Our_R new_A office_N in_F Leeds_N | Odo_N Marsh_N with_F Harbour_N News_N
The_F board_N approved_V a_F budget_N of_F 40_C million_C dollars_N | They_R have_V not_A paid_V the_F fee_N | Rain_N fell_V on_F the_F northern_A coast_N | A_F quick_A note_N about_F safety_N | It_R is_V late_A
Profits_N rose_V sharply_A in_F March_N | The_F old_A bridge_N over_F the_F river_N | He_R must_M return_V the_F keys_N | Prices_N may_M fall_V next_A year_N | Crews_N are_V repairing_V the_F line_N
We_R expect_V higher_A costs_N | The_F minister_N said_V that_F taxes_N would_M rise_V | Three_C ships_N sank_V near_F the_F island_N | Chief_A Financial_A Officer_N of_F the_F company_N | No_F further_A questions_N
The_F report_N shows_V a_F decline_N in_F sales_N | I_R think_V this_R works_V | You_R can_M see_V the_F results_N | Sales_N declined_V by_F 3.5_C percent_N | The_F tenant_N shall_M pay_V rent_N monthly_A
Both_F parties_N agree_V to_F these_F terms_N | The_F harbour_N master_N and_F his_R deputy_N | Members_N voted_V against_F the_F plan_N | This_F policy_N has_V failed_V | Inflation_N was_V lower_A than_F expected_V
A_F long_A and_F bitter_A dispute_N | She_R had_V been_V waiting_V for_F hours_N | The_F study_N found_V no_F link_N between_F them_R | Workers_N demanded_V better_A pay_N | The_F price_N of_F copper_N
Investors_N sold_V their_R shares_N quickly_A | There_R were_V many_A reasons_N | The_F two_C leaders_N met_V in_F Paris_N | He_R could_M not_A explain_V it_R | Our_R engineers_N built_V the_F new_A system_N
The_F most_A recent_A figures_N from_F the_F agency_N | Trains_N run_V every_F hour_N | Demand_N has_V increased_V since_F 2021_C | The_F committee_N meets_V twice_A a_F month_N | Good_A morning_N everyone_R
They_R were_V told_V to_F leave_V | The_F city_N council_N rejected_V the_F offer_N | An_F early_A morning_N in_F spring_N | You_R should_M call_V the_F bank_N | The_F bank_N raised_V its_R rate_N
Costs_N remain_V high_A | The_F new_A law_N bans_V smoking_N in_F bars_N | Some_F analysts_N believe_V growth_N will_M slow_V | The_F team_N won_V four_C games_N | A_F small_A town_N near_F the_F border_N
I_R do_V not_A know_V him_R | The_F dog_N chased_V a_F cat_N | It_R does_V not_A matter_V | The_F factory_N employs_V 300_C people_N | These_F changes_N might_M affect_V you_R
Mary_N Jones_N of_F the_F Evening_N Post_N | The_F editor_N wrote_V a_F short_A letter_N | Water_N levels_N dropped_V again_A | We_R are_V pleased_A with_F the_F outcome_N | The_F results_N were_V strong_A
The_F supplier_N delivers_V parts_N weekly_A | He_R became_V chairman_N in_F 1998_C | Farmers_N grow_V wheat_N here_A | The_F lack_N of_F clear_A rules_N | They_R began_V the_F work_N in_F June_N
The_F ship_N carries_V grain_N and_F oil_N | Nobody_R knows_V the_F answer_N | The_F contract_N ends_V in_F May_N | She_R gave_V him_R the_F book_N | An_F unusually_A warm_A winter_N
The_F manager_N told_V staff_N about_F the_F closure_N | Output_N fell_V to_F a_F record_A low_N | He_R speaks_V French_N well_A | Two_C of_F the_F five_C directors_N resigned_V | The_F other_A side_N of_F the_F street_N
Shares_N closed_V lower_A on_F Friday_N | The_F court_N ruled_V that_F the_F ban_N was_V illegal_A | Most_A of_F our_R customers_N live_V abroad_A | The_F engine_N stopped_V suddenly_A | A_F letter_N from_F the_F governor_N
The_F data_N suggest_V otherwise_A | Banks_N lend_V money_N | The_F group_N operates_V in_F twelve_C countries_N | It_R has_V become_V a_F problem_N | The_F head_N of_F research_N at_F the_F institute_N
The_F company_N makes_V steel_N | I_R want_V to_F thank_V the_F staff_N | They_R might_M have_V known_V | The_F museum_N opens_V at_F nine_C | Bright_A lights_N above_F the_F stage_N
The_F president_N visited_V the_F region_N | Exports_N account_V for_F half_N of_F sales_N | The_F roof_N needs_V repair_N | We_R used_V a_F simple_A method_N | A_F list_N of_F all_F known_A errors_N
The_F parties_N signed_V the_F agreement_N in_F April_N | Nothing_R happened_V | The_F programme_N trains_V young_A nurses_N | The_F storm_N damaged_V several_A houses_N | A_F former_A member_N of_F parliament_N
Unemployment_N stands_V at_F 5%_C | The_F letter_N says_V nothing_R new_A | Passengers_N waited_V outside_A | She_R lives_V in_F a_F quiet_A village_N | The_F final_A version_N of_F the_F text_N
Taxes_N went_V up_A | The_F firm_N plans_V to_F hire_V 50_C workers_N | His_R answer_N surprised_V us_R | The_F road_N leads_V to_F the_F sea_N | Heavy_A traffic_N on_F the_F ring_N road_N
"""
#: Words whose tag is known without training.
MODALS = ("will", "would", "can", "could", "shall", "should", "may", "might", "must")
LEXICON = {w: "M" if w in MODALS else "V" for w in T.VERBS} | dict.fromkeys(T.NUMBER_WORDS, "C") | dict.fromkeys("i you he she it we they him her them us who".split(), "R") | dict.fromkeys("a an the of in on at by for with from to and or but as that than into over under".split(), "F")


def labelled(spark: SparkSession, text: str = LABELLED) -> DataFrame:
    """(sentence, place, word, tag) of labelled sentences."""
    rows = [(i, j, *w.rsplit("_", 1)) for i, s in enumerate(re.split(r"[|\n]", text.strip())) for j, w in enumerate(s.split())]
    return spark.createDataFrame(rows, "sentence long, place int, word string, tag string")


def shape(word: str) -> str:
    return "digit" if word[0].isdigit() else "capital" if word[0].isupper() else "small"


@dataclass
class Model:
    """Logarithms of probabilities; ``words`` and ``ends`` give a row of the tags' for a word, or for its ending and shape."""

    first: np.ndarray
    follow: np.ndarray
    words: dict[str, np.ndarray]
    ends: dict[str, np.ndarray]
    shapes: dict[str, np.ndarray] = field(default_factory=dict)

    def gives(self, word: str, at: int) -> np.ndarray:
        """How likely each tag gives the word; the first word's shape says nothing."""
        low = word.lower()
        if low in self.words:
            return self.words[low]
        look = self.shapes[shape(word)] if at or shape(word) == "digit" else np.zeros(len(TAGS))
        return look + next(self.ends[low[len(low) - n :]] for n in (4, 3, 2, 1, 0) if low[len(low) - n :] in self.ends and n <= len(low))


def train(rows: DataFrame) -> Model:
    """A model of labelled rows (sentence, place, word, tag): counts by Spark, of which each word, ending and pair of tags is one row.

    Tasks hold the model, so the labelled set's vocabulary has to fit; texts to tag may be of any size.
    """
    before = rows.select("sentence", (F.col("place") + 1).alias("place"), F.col("tag").alias("before"))
    pairs = rows.join(before, ["sentence", "place"], "left").groupBy("before", "tag").count().collect()
    low, length = F.lower("word"), F.length("word")
    keys = F.concat(F.array(F.concat(F.lit("w"), low)), F.transform(F.sequence(F.lit(1), F.least(length, F.lit(4))), lambda n: F.concat(F.lit("e"), F.substr(low, length - n + 1))), F.array(F.concat(F.lit("s"), F.when(F.col("word").rlike("^[0-9]"), "digit").when(F.col("word").rlike("^[A-Z]") & (F.col("place") > 0), "capital").when(F.col("place") > 0, "small").otherwise("any"))))
    given = rows.select("tag", F.explode(keys).alias("key")).groupBy("key", "tag").count().collect()

    at = {t: i for i, t in enumerate(TAGS)}
    follow, first = np.full((len(TAGS), len(TAGS)), 0.5), np.full(len(TAGS), 0.5)
    for before_, tag, n in pairs:
        if before_ is None:
            first[at[tag]] += n
        else:
            follow[at[before_], at[tag]] += n
    counts: dict[str, np.ndarray] = {}
    for key, tag, n in given:
        counts.setdefault(key, np.zeros(len(TAGS)))[at[tag]] += n
    total = sum((c for k, c in counts.items() if k[0] == "w"), np.zeros(len(TAGS))) + 1e-9
    # closed classes give few new words, so what words there are only once says how new ones are spread
    once = sum((c for k, c in counts.items() if k[0] == "w" and c.sum() == 1), np.zeros(len(TAGS))) + 0.1

    def row(c: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
        return np.log((c + weight * prior / prior.sum()) / (c.sum() + weight)) - np.log(total / total.sum())

    words = {k[1:]: row(c, once, 0.05) for k, c in counts.items() if k[0] == "w"}
    # an ending's tags lean on those of the ending one letter shorter
    spread = {"": once / once.sum()}
    for end in sorted((k[1:] for k in counts if k[0] == "e"), key=len):
        c = counts["e" + end]
        spread[end] = (c + 1.5 * spread[end[1:]]) / (c.sum() + 1.5)
    ends = {end: np.log(p) - np.log(total / total.sum()) for end, p in spread.items()}
    for word, tag in LEXICON.items():
        words.setdefault(word, row(np.eye(len(TAGS))[at[tag]], once, 0.05))
    shapes = {s: np.log((counts.get("s" + s, np.zeros(len(TAGS))) + 0.5) / (total + 1)) for s in ("digit", "capital", "small")}
    return Model(np.log(first / first.sum()), np.log(follow / follow.sum(axis=1, keepdims=True)), words, ends, shapes)


def viterbi(first: np.ndarray, follow: np.ndarray, gives: np.ndarray) -> list[int]:
    """The likeliest tags; of equal ones those of smaller numbers, from the end."""
    score, came = first + gives[0], []
    for row in gives[1:]:
        through = score[:, None] + follow
        came.append(through.argmax(axis=0))
        score = through[came[-1], np.arange(len(score))] + row
    path = [int(score.argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return path[::-1]


def viterbi_many(first: np.ndarray, follow: np.ndarray, gives: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``viterbi`` for many sentences at once: ``words`` (sentences x places) are rows of ``gives``; places from a sentence's length on don't count."""
    n, most = words.shape
    every = np.arange(n)
    score, came = first + gives[words[:, 0]], np.zeros((most, n, len(first)), np.int8)
    came[:] = np.arange(len(first))
    for at in range(1, most):
        goes_on = lengths > at
        through = score[:, :, None] + follow
        back = through.argmax(axis=1)
        came[at] = np.where(goes_on[:, None], back, came[at])
        score = np.where(goes_on[:, None], np.take_along_axis(through, back[:, None, :], axis=1)[:, 0] + gives[words[:, at]], score)
    out = np.zeros((n, most), np.int8)
    tag = score.argmax(axis=1)
    for at in range(most - 1, -1, -1):
        out[:, at] = tag
        tag = came[at, every, tag]
    return out


#: Words of sentences, padding included, that are decoded together, and different words of a step whose probabilities are held.
STEP_WORDS, HELD = 100_000, 100_000


def words_of(text: str | None) -> list[str]:
    """The words of a text; one that is mostly in capitals is read in small letters."""
    text = (text or "").replace("’", "'")
    capitals = sum(map(str.isupper, text))
    if capitals and capitals > 0.8 * sum(map(str.isalpha, text)):
        text = text.lower()
    return re.findall(WORD, text)


class _Given:
    """``Model.gives`` of words as row numbers of a table: each word is looked up once."""

    def __init__(self, model: Model):
        self.words = {w: i for i, w in enumerate(model.words)}
        self.ends = {e: len(self.words) + i for i, e in enumerate(model.ends)}
        self.rows = np.stack([*model.words.values(), *model.ends.values()])
        self.shapes, self.looks = {s: i + 1 for i, s in enumerate(model.shapes)}, np.stack([np.zeros(len(TAGS)), *model.shapes.values()])
        self.numbers: dict[tuple[str, bool], int] = {}
        self.row: list[int] = []
        self.look: list[int] = []

    def number(self, key: tuple[str, bool]) -> int:
        word, later = key
        low = word.lower()
        row, look = self.words.get(low), 0
        if row is None:
            kind = shape(word)
            look = self.shapes[kind] if later or kind == "digit" else 0
            row = next(self.ends[low[len(low) - n :]] for n in (4, 3, 2, 1, 0) if n <= len(low) and low[len(low) - n :] in self.ends)
        self.row.append(row)
        self.look.append(look)
        self.numbers[key] = len(self.numbers)
        return self.numbers[key]

    def table(self) -> np.ndarray:
        return self.looks[self.look] + self.rows[self.row]


def _steps(model: Model, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the texts, gives, words, lengths) for ``viterbi_many``: texts of like lengths, as many as a step takes; texts without words are in none."""
    split = [words_of(t) for t in texts]
    order = sorted((i for i, w in enumerate(split) if w), key=lambda i: len(split[i]))
    given, start = _Given(model), 0
    while start < len(order):
        if len(given.numbers) >= HELD:
            given = _Given(model)
        shortest = len(split[order[start]])
        end = start + 1
        while end < len(order) and (end - start + 1) * len(split[order[end]]) <= STEP_WORDS and len(split[order[end]]) <= 2 * shortest + 4:
            end += 1
        part = order[start:end]
        known, number = given.numbers, given.number
        flat = []
        for i in part:
            own = split[i]
            for at, w in enumerate(own):
                key = (w, at > 0)
                found = known.get(key)
                flat.append(number(key) if found is None else found)
        lengths = np.array([len(split[i]) for i in part])
        words = np.zeros((len(part), lengths.max()), np.int64)
        words[np.arange(lengths.max()) < lengths[:, None]] = flat
        yield part, given.table(), words, lengths
        start = end


def tags_of_many(model: Model, texts: list[str | None]) -> list[str]:
    """A letter for each word of each text."""
    letters = np.array(list(TAGS))
    out = [""] * len(texts)
    for part, gives, words, lengths in _steps(model, texts):
        found = letters[viterbi_many(model.first, model.follow, gives, words, lengths)]
        for row, i in enumerate(part):
            out[i] = "".join(found[row, : lengths[row]])
    return out


def any_of_many(model: Model, texts: list[str | None], tags: str = ASSERTS) -> np.ndarray:
    """Whether the best tags of each text hold one of ``tags``."""
    wanted = np.array([t in tags for t in TAGS])
    out = np.zeros(len(texts), bool)
    for part, gives, words, lengths in _steps(model, texts):
        inside = np.arange(words.shape[1]) < lengths[:, None]
        out[part] = (wanted[viterbi_many(model.first, model.follow, gives, words, lengths)] & inside).any(axis=1)
    return out


def tags_of(model: Model, text: str | None) -> str:
    """A letter for each word of a text."""
    return tags_of_many(model, [text])[0]


def tagged(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` with tags, a letter for each word of the text; null and empty texts have none."""
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(tags_of_many(model, batch.column(text).to_pylist()), pa.string())
            yield pa.record_batch([*batch.columns, found], names=[*names, "tags"])

    return rows.mapInArrow(run, f"{kinds}, tags string")


def asserts(model: Model):
    """A column function: whether a sentence has a verb, a modal or a number, in digits or in words."""

    @pandas_udf("boolean")
    def found(texts):
        return pd.Series(any_of_many(model, texts.tolist()))

    number = rf"(?<![A-Za-z])(?i:{'|'.join(T.NUMBER_WORDS)})(?![A-Za-z])"

    def check(text: Column) -> Column:
        sure = text.rlike("[0-9]") | text.rlike(number)
        # the tagger reads what isn't settled without it
        return sure | found(F.when(~sure, text))

    return check


def log_of(model: Model, words: list[str], tags: list[int]) -> float:
    """The logarithm of the probability of words with tags."""
    total = model.first[tags[0]] + sum(model.follow[a, b] for a, b in zip(tags, tags[1:], strict=False))
    return float(total + math.fsum(model.gives(w, i)[t] for i, (w, t) in enumerate(zip(words, tags, strict=True))))
