"""Fill-in-middle transformation by an automaton's event scan.

Units are words with the whitespace before them, and whitespace at the end is a unit of its own.  One Aho-Corasick
automaton finds the whitespace characters, which are ASCII, and the sentinels; nothing else of a text is looked at.
A gap between two whitespace events is one word or none, by its length, so units are counted by subtraction, and the
offset after the k-th unit is an entry of the sparse list of the gaps' ends.

Whether a document is transformed, how, and where it is cut are drawn from a SHA-256 of seed and id.  Texts that are
empty or hold a sentinel stay plain, which makes every output reversible: `restored` rebuilds the text from output and
form alone.  Null texts count as empty.  A null id draws like the empty id.  Rows that share an id draw alike, each
row is transformed by itself, an empty table gives no rows, other columns are ignored.  Long texts are scanned in
blocks of events; what is held of them is one offset for each unit.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, map_slices, table

SPACES = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Events that one step of the scan holds.
EVENTS = 1 << 16
_SPACE, _SENTINEL = 0, 1
_FORMS = ("plain", "spm", "psm")
_SCHEMA = "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in SPACES:
        found.add_word(c, _SPACE)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(mark, _SENTINEL)
    found.make_automaton()
    return found


def scan(text: str) -> tuple[np.ndarray, bool]:
    """Where each unit ends, in code points, and whether the text holds a sentinel."""
    events: Iterable = automaton().iter(text)
    ends, last, marked = [], -1, False
    while len(block := np.fromiter((2 * at + kind for at, kind in islice(events, EVENTS)), np.int64)):
        at = block >> 1
        spaces = block & 1 == _SPACE
        if not spaces.all():
            marked, at = True, at[spaces]
        if len(at):
            ends.append(at[np.diff(at, prepend=last) > 1])
            last = int(at[-1])
    return np.concatenate([*ends, np.array([len(text)] if text else [], np.int64)]), marked


def _transform(rows: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    cuts = [rows.column(c).to_numpy() for c in ("h1", "h2")]
    drawn, order = rows.column("h3").to_numpy() % 100 < rate, rows.column("h4").to_numpy() % 100 < spm
    out = {c: [] for c in ("n", "form", "output", "prefix_chars", "middle_chars")}
    for i, text in enumerate(rows.column("text").to_pylist()):
        ends, marked = scan(text)
        n = len(ends)
        if not text or marked or not drawn[i]:
            row = (n, _FORMS[0], text, None, None)
        else:
            a, b = (int(ends[k - 1]) if k else 0 for k in sorted(int(c[i]) % (n + 1) for c in cuts))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if order[i] else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
            row = (n, _FORMS[1] if order[i] else _FORMS[2], output, a, b - a)
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    kinds = {"form": pa.string(), "output": pa.string()}
    return pa.record_batch({"doc_id": rows.column("doc_id")} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n units, form, output, prefix_chars and middle_chars (null where plain) for every row of docs (doc_id, text).

    ``rate`` in 100 documents are transformed, of those ``spm`` in 100 with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest")).select("doc_id", "text", *draws)
    return map_slices(rows, lambda part: _transform(part, rate, spm), _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; sentinels are found at their first places, since the text held none."""
    mark = len(PREFIX)
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    part = lambda begin, end: F.substr(output, begin + mark, end - begin - mark)
    middle = F.substr(output, m + mark)
    psm, spm = F.concat(part(p, s), middle, part(s, m)), F.concat(part(p, m), middle, part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(docs_of(table(spark, sf_dir, "documents")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
cut AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle, array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(coalesce(prefix, ''))::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(coalesce(middle, ''))::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || coalesce(suffix, '') || '<P>' || coalesce(prefix, '') || '<M>' || coalesce(middle, '') ELSE '<P>' || coalesce(prefix, '') || '<S>' || coalesce(suffix, '') || '<M>' || coalesce(middle, '') END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM cut
"""
