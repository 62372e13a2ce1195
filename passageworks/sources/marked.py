"""Readers of marked-up text, lexicons and synonym lists."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.durable import durable
from passageworks.functions.ordering import carried, dense_ids
from passageworks.functions.text import concept_code
from passageworks.functions.wordlists import COLLECTIONS, SCOPES

MARKUP_SCHEMA = "text string, spans array<struct<start:int,end:int,codes:array<string>>>, italic array<struct<start:int,end:int>>, red array<struct<start:int,end:int>>"


def parse_markup(marked: str) -> dict:
    """``{words|H1,H2}`` tags, ``[italic]`` (nests), ``<red>`` (unclosed: to the end); other unclosed marks are errors."""
    text, spans, italic, red = [], [], [], []
    size, tag, opened, red_at, k = 0, None, [], None, 0
    while k < len(marked):
        c = marked[k]
        if c == "{":
            tag = size
        elif c == "|" and tag is not None:
            close = marked.index("}", k)
            spans.append({"start": tag, "end": size, "codes": [x for x in marked[k + 1 : close].split(",") if x]})
            tag, k = None, close
        elif c == "[":
            opened.append(size)
        elif c == "]":
            italic.append({"start": opened.pop(), "end": size})
        elif c == "<":
            red_at = size
        elif c == ">":
            if red_at is None:
                raise ValueError(f"unopened > in {marked!r}")
            red.append({"start": red_at, "end": size})
            red_at = None
        else:
            text.append(c)
            size += 1
        k += 1
    if tag is not None or opened:
        raise ValueError(f"unclosed mark in {marked!r}")
    if red_at is not None:
        red.append({"start": red_at, "end": size})
    return {"text": "".join(text), "spans": spans, "italic": italic, "red": red}


#: Rows that are Python objects at once; the rest of a batch is packed in Arrow.
PARSED_AT_ONCE = 64
MARKUP_TYPE = pa.struct(
    [
        ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("codes", pa.list_(pa.string()))]))),
        ("italic", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("red", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def parse_all(marked: pa.Array) -> pa.Array:
    """Few rows at a time, since every range of a text is a Python object until it is packed."""
    parts = [pa.array([parse_markup(m) for m in marked.slice(k, PARSED_AT_ONCE).to_pylist()], MARKUP_TYPE) for k in range(0, len(marked), PARSED_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], MARKUP_TYPE)


def markup(marked: str) -> Column:
    """Struct of text, spans, italic and red ranges of a marked text column."""
    return F.arrow_udf(parse_all, MARKUP_SCHEMA)(marked)


def stripped(marked: Column) -> Column:
    """Only the words of marked text."""
    return F.regexp_replace(F.regexp_replace(marked, r"\{([^|}]*)\|[^}]*\}", "$1"), r"[\[\]<>]", "")


def collections(spark: SparkSession) -> DataFrame:
    """(coll, code, name, short, aliases) of the canonical collections."""
    rows = [line.split("|") for line in COLLECTIONS.strip().splitlines()]
    return spark.createDataFrame([(k, code, name, short, aliases.split()) for k, (code, name, short, aliases) in enumerate(rows)], "coll int, code string, name string, short string, aliases array<string>")


def scopes(spark: SparkSession) -> DataFrame:
    """(scope, coll) of the named ranges of collections."""
    codes = [line.split("|")[0] for line in COLLECTIONS.strip().splitlines()]
    rows = []
    for pair in SCOPES.split():
        name, ends = pair.split("=")
        first, last = ends.split("-")
        rows += [(name, k) for k in range(codes.index(first), codes.index(last) + 1)]
    return spark.createDataFrame(rows, "scope string, coll int")


def read_marked(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, titles) of a TSV of collection code, group, number and marked text.

    A row of number 0 is a title and belongs to the next passage. A code that ``known`` lacks is an error.
    """
    raw = spark.read.csv(path, sep="\t", schema="code string, grp int, num int, marked string", quote="", encoding="UTF-8")
    rows = raw.join(F.broadcast(known.select("coll", "code")), "code", "left").withColumn("coll", F.when(F.col("coll").isNull(), F.raise_error(F.concat(F.lit("unknown collection "), F.col("code")))).otherwise(F.col("coll")).cast("int"))
    # one key of collection and group, so that the buckets of the order cut collections too; a title goes to the row after it
    lined = durable(dense_ids(rows.withColumn("_key", F.col("coll") * F.lit(1 << 32) + F.col("grp")), ["_key", "num"], "_line"))
    heads = lined.filter("num = 0").select((F.col("_line") + 1).alias("_line"), F.col("marked").alias("_title"))
    verses = lined.filter("num > 0").join(heads, "_line", "left").withColumn("m", markup("marked"))
    verses = durable(dense_ids(verses, ["_line"], "passage_id"))
    passages = verses.select("passage_id", "coll", "grp", "num", "m.text", "m.spans", "m.italic", "m.red")
    titles = verses.filter("_title is not null").select("passage_id", stripped(F.col("_title")).alias("title"))
    return passages, titles


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(code, lemma, translit, pron, derivation, definition, usage); rows with a bad code are left out."""
    schema = "id string, lemma string, translit string, pron string, derivation string, definition string, usage string"
    raw = spark.read.csv(path, sep="\t", schema=schema, quote="", encoding="UTF-8").fillna("")
    return raw.withColumn("code", concept_code(F.col("id"))).filter("code is not null").drop("id").select("code", "lemma", "translit", "pron", "derivation", "definition", "usage")


def read_weighted_synonyms(spark: SparkSession, path: str, least: int = 25) -> DataFrame:
    """(key, word, weight) of ``key TAB word:weight ...``, weights of at least ``least``."""
    raw = spark.read.csv(path, sep="\t", schema="key string, rest string", quote="")
    pairs = raw.select("key", F.explode(F.split("rest", " +")).alias("pair")).select("key", F.split("pair", ":").alias("p"))
    return pairs.select("key", F.get("p", F.lit(0)).alias("word"), F.get("p", F.lit(1)).cast("int").alias("weight")).filter(F.col("weight") >= least)


def read_hand_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(key, word, 100) of ``key TAB word word ...``; lines from # and blank lines are left out."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.select(F.split("value", "\t").alias("p"))
    return parts.select(F.get("p", F.lit(0)).alias("key"), F.explode(F.split(F.trim(F.get("p", F.lit(1))), r"\s+")).alias("word")).select("key", "word", F.lit(100).alias("weight"))


def usfm_marks(text: Column) -> Column:
    """Inline USFM as the marks of this module: notes go, tagged words, additions and red letters stay."""
    out = F.regexp_replace(text, r"\\f .*?\\f\*", "")
    out = F.regexp_replace(out, r'\\\+?w ([^|\\]*)\|[^\\]*?strong="([^"]*)"[^\\]*\\\+?w\*', r"{$1|$2}")
    out = F.regexp_replace(out, r"([HG])0+(?=[1-9])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\\\+?add\*", "]"), r"\\\+?add ", "[")
    out = F.regexp_replace(F.regexp_replace(out, r"\\\+?wj\*", ">"), r"\\\+?wj ", "<")
    return F.when(out.contains("\\"), F.raise_error(F.concat(F.lit("unknown mark in "), out))).otherwise(F.trim(F.regexp_replace(out, r"\s+", " ")))


def usfm_verses(lines: DataFrame) -> DataFrame:
    """(coll, grp, num, text) of USFM lines (coll, line, value): chapter and verse marks carry on over the lines below them.

    Continuation lines join the verse above; a description before the first verse has number 0.
    """
    grp = F.expr(r"nullif(regexp_extract(value, '^\\\\c +([0-9]+)', 1), '')").cast("int")
    verse = F.expr(r"nullif(regexp_extract(value, '^\\\\v +([0-9]+)', 1), '')").cast("int")
    is_chapter = F.col("value").rlike(r"^\\c ")
    placed = carried(lines.select("coll", "line", "value"), "coll", "line", grp=grp, num=F.when(is_chapter, F.lit(0)).otherwise(verse))
    rest = F.trim(F.regexp_replace(F.col("value"), r"^\\(v +[0-9]+|q[0-9]?|p|b|m|d|c +[0-9]+) ?", ""))
    marked = placed.select("coll", "line", "grp", "num", rest.alias("part"), F.col("value").rlike(r"^\\(v|q|p|b|m|d)").alias("body"))
    kept = marked.filter("grp is not null and body and part <> ''")
    joined = kept.groupBy("coll", "grp", "num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda s: s["part"]), " ").alias("raw"))
    return joined.select("coll", "grp", "num", usfm_marks(F.col("raw")).alias("text"))


def weighted_senses(senses: DataFrame) -> DataFrame:
    """(key, word, weight) of (key, sense_rank, word, similar): later senses fade, similar words count six tenths, best of each word."""
    value = F.lit(100) / (1 + 0.5 * F.col("sense_rank")) * F.when(F.col("similar"), 0.6).otherwise(1.0)
    proper = senses.filter(F.col("word").rlike("^[a-z]+$") & (F.col("word") != F.col("key")))
    return proper.groupBy("key", "word").agg(F.max(F.round(value)).cast("int").alias("weight"))


def join_outside(passages: DataFrame, outside: DataFrame) -> DataFrame:
    """(passage_id, other) from outside chapter texts (coll, grp, text) with ``[n]`` before each verse; verses past the last join it."""
    cut = outside.select("coll", "grp", F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]\s*([^\[]*)"), F.lit(0))).alias("v"))
    verses = cut.select("coll", "grp", F.regexp_extract("v", r"\[(\d+)\]", 1).cast("int").alias("n"), F.trim(F.regexp_extract("v", r"(?s)\]\s*(.*)", 1)).alias("part"))
    last = passages.groupBy("coll", "grp").agg(F.max("num").alias("last"))
    placed = verses.join(last, ["coll", "grp"]).withColumn("num", F.least("n", "last"))
    joined = placed.groupBy("coll", "grp", "num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda s: s["part"]), " ").alias("other"))
    return passages.join(joined, ["coll", "grp", "num"]).select("passage_id", "other")


def spoken(text: Column, heading: Column | None = None) -> Column:
    """Text for reading aloud: the first paragraph sign goes, words of capitals are capitalised; ``heading`` (null: none) stands before a group's first passage."""
    plain = F.trim(F.regexp_replace(text, "^([^¶]*)¶", "$1"))
    words = F.regexp_extract_all(plain, F.lit(r"(?s)\b[A-Z]{2,}\b|."), F.lit(0))
    said = F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z]{2,}$"), F.initcap(F.lower(w))).otherwise(w)), "")
    return said if heading is None else F.concat(F.coalesce(F.concat(heading, F.lit(". ")), F.lit("")), said)


def headings(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(passage_id, heading): the name and number of each group at its first passage."""
    return groups.join(F.broadcast(known.select("coll", "name")), "coll").select(F.col("first_id").alias("passage_id"), F.concat_ws(" ", "name", "grp").alias("heading"))
