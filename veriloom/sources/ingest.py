"""Document sources: text, Markdown, JSON, Word and PDF files, web pages, labelled pairs and saved runs."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What each extension is read as.
FORMATS = {".txt": "text", ".md": "markdown", ".pdf": "pdf", ".json": "json", ".docx": "docx"}
_SCHEMA = "path string, format string, text string, error string"
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Least text of a PDF's text layer.
LEAST_CHARS, LEAST_CHARS_A_PAGE = 200, 25
ZONE, SHARE, LEAST_PAGES = 3, 0.5, 3


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, error) of every file under ``path``: one row each, with the reason where a file can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    known = F.coalesce(*[F.when(ext == e, F.lit(k)) for e, k in FORMATS.items()])
    tagged = files.select("path", known.alias("format"), "content")
    unknown = tagged.where("format IS NULL").select("path", "format", F.lit(None).cast("string").alias("text"), F.lit(f"unsupported format; known: {', '.join(FORMATS)}").alias("error"))
    return plain_texts(tagged.where("format IN ('text', 'markdown')")).unionByName(json_documents(tagged.where("format = 'json'"))).unionByName(_parsed(tagged.where("format IN ('docx', 'pdf')"))).unionByName(unknown)


def plain_texts(files: DataFrame) -> DataFrame:
    """SRC2: UTF-8 without its byte order mark; NUL bytes and other encodings are errors."""
    nul = F.hex("content").rlike("^(?:..)*00")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), "^﻿", ""), "\r\n?", "\n")
    error = F.when(nul, "binary data").when(~valid, "not UTF-8")
    return files.select("path", "format", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def json_documents(files: DataFrame) -> DataFrame:
    """SRC7: exactly one of text, document and sections; titles become headings."""
    shape = "title string, text string, document string, sections array<variant>"
    loose = F.from_json(F.col("content").cast("string"), "title string, text string, document string, sections string")
    rows = files.select("path", "format", F.col("content").cast("string").alias("raw"), loose.alias("j"))
    keys = sum((F.col(f"j.{k}").isNotNull().cast("int") for k in ("text", "document", "sections")), F.lit(0))
    as_text = F.from_json(F.col("j.sections"), "array<string>")
    as_struct = F.from_json(F.col("j.sections"), "array<struct<title:string,text:string>>")
    titled = F.array_join(F.transform(F.filter(as_struct, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != ""), lambda s: F.when(s["title"].isNotNull(), F.concat(F.lit("## "), s["title"], F.lit("\n\n"), s["text"])).otherwise(s["text"])), "\n\n")
    plain = F.array_join(F.filter(as_text, lambda s: F.trim(s) != ""), "\n\n")
    body = F.coalesce(F.col("j.text"), F.col("j.document"), F.when(F.col("j.sections").rlike(r"^\s*\[\s*\{"), titled).otherwise(plain))
    head = F.when(F.col("j.title").isNotNull(), F.concat(F.lit("# "), "j.title", F.lit("\n\n"))).otherwise("")
    error = F.when(keys != 1, f"needs exactly one of {{text}}, {{document}}, {{sections}} ({shape})")
    return rows.select("path", "format", F.when(error.isNull(), F.concat(head, body)).alias("text"), error.alias("error"))


def _docx(data: bytes) -> str:
    out = []
    for p in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).iter(f"{_WORD_NS}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_WORD_NS}t")).strip()
        style = p.find(f"{_WORD_NS}pPr/{_WORD_NS}pStyle")
        name = style.get(f"{_WORD_NS}val", "") if style is not None else ""
        level = 1 if name == "Title" else min(int(m[1]) + 1, 6) if (m := re.match(r"Heading ?(\d+)", name)) else 0
        if text:
            out.append("#" * level + " " * bool(level) + text)
    return "\n\n".join(out)


def _pdf(data: bytes) -> str:
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF parser is installed") from e
    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted and not reader.decrypt(""):
        raise ValueError("the PDF needs a password")
    return text_layer([page.extract_text() or "" for page in reader.pages])


def text_layer(pages: list[str]) -> str:
    """The pages, parted by form feeds, if they hold enough text to be more than scans."""
    size = sum(len(p.strip()) for p in pages)
    if size < max(LEAST_CHARS, LEAST_CHARS_A_PAGE * len(pages)):
        raise ValueError(f"the PDF has no text layer: {size} characters on {len(pages)} pages")
    return "\f".join(pages)


def rejoin(text: Column) -> Column:
    """SRC4: words that a line end parted at a hyphen, whole again."""
    return F.regexp_replace(text, "([a-z])-\n([a-z])", "$1$2")


def _parsed(files: DataFrame) -> DataFrame:
    """SRC3, SRC8: file by file; a parser's complaint is the row's error."""

    def parse(frames):
        for frame in frames:
            rows = []
            for path, kind, data in zip(frame["path"], frame["format"], frame["content"], strict=True):
                try:
                    rows.append((path, kind, (_docx if kind == "docx" else _pdf)(bytes(data)), None))
                except Exception as e:  # noqa: BLE001  any damage of a file is that file's error
                    rows.append((path, kind, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "format", "text", "error"])

    return files.mapInPandas(parse, _SCHEMA)


def clean_pages(lines: DataFrame) -> DataFrame:
    """SRC4, AGG4: (doc_id, page, i, line) without page numbers and without the lines that run through the pages' ends.

    A line counts once a page, in the first or last three that aren't blank; it runs through the document if it
    stands on half of the pages and on three at least.
    """
    full = F.trim("line") != ""
    # lines move once, to their document; places, pages and keys are counted there, a page by its first line
    doc, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page")
    lines = lines.repartition("doc_id").withColumn("full", full.cast("int"))
    ranked = lines.withColumn("from_top", F.sum("full").over(page.orderBy("i"))).withColumn("all_full", F.sum("full").over(page))
    # lines that share a place count together from either end, as in a running sum
    ranked = ranked.withColumn("own_place", F.sum("full").over(Window.partitionBy("doc_id", "page", "i"))).withColumn("from_end", F.col("all_full") - F.col("from_top") + F.col("own_place"))
    numbered = F.col("line").rlike(T.PAGE_NUMBER) & full
    zoned = ranked.withColumn("zone", full & ((F.col("from_top") <= ZONE) | (F.col("from_end") <= ZONE))).withColumn("number", numbered)
    # keys are needed in the zones alone
    zoned = zoned.withColumn("key", F.when(F.col("zone"), T.header_key(F.col("line"))))
    zoned = zoned.withColumn("starts", (F.row_number().over(page.orderBy("i")) == 1).cast("int")).withColumn("pages", F.sum("starts").over(doc))
    zoned = zoned.withColumn("held", F.col("zone") & ~F.col("number"))
    zoned = zoned.withColumn("stands", (F.col("held") & (F.row_number().over(Window.partitionBy("doc_id", "key", "held", "page").orderBy("i")) == 1)).cast("int"))
    standing = F.sum("stands").over(Window.partitionBy("doc_id", "key"))
    runs = (standing >= F.greatest(F.lit(float(LEAST_PAGES)), SHARE * F.col("pages"))) & (F.col("key") != "") & F.col("doc_id").isNotNull()
    return zoned.withColumn("runs", F.coalesce(F.col("zone") & runs, F.lit(False))).where(~F.col("number") & ~F.col("runs")).select("doc_id", "page", "i", "line")


def html_to_text(html: Column) -> Column:
    """SRC9: scripts, styles and tags go, the common entities are resolved, white space collapses."""
    x = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return T.normalize_ws(x)


def labelled_pairs(spark: SparkSession, candidates: str, labels: str, constructed: str) -> DataFrame:
    """SRC10: JSON lines of candidate pairs with their labels, and the constructed pairs."""
    shape = "id string, a string, b string"
    return with_labels(spark.read.schema(shape).json(candidates), spark.read.schema("id string, label string").json(labels), spark.read.schema(shape + ", label string").json(constructed))


def with_labels(candidates: DataFrame, labels: DataFrame, constructed: DataFrame) -> DataFrame:
    """Candidate pairs (id, a, b) that have a label (id, label), and the constructed pairs, which bring theirs."""
    return candidates.join(labels, "id").unionByName(constructed)


def frozen(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: (path, sha256) of label files, to hold against the digests they were frozen with."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_frozen(spark: SparkSession, path: str, digests: dict[str, str]) -> None:
    """SRC11: an error that names the files, by their last name part, whose digest isn't the one they were frozen with, or that are missing."""
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in frozen(spark, path).collect()}  # a few label files
    if wrong := sorted(name for name, digest in digests.items() if found.get(name) != digest):
        raise ValueError(f"frozen inputs have changed: {', '.join(wrong)}")
