"""Reading around results: groups, windows, steps, lexicon entries, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.functions.durable import durable
from passageworks.functions.ordering import dense_ids
from passageworks.operators.index import IndexTables


def neighbours(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """(coll, grp, previous, next) of ``asked`` groups: first passages of the groups before and after, -1 at the ends of the collection.

    The few groups asked for are broadcast to one pass over all groups, which keeps a greatest and a least id for each.
    """
    own = groups.join(F.broadcast(asked.select("coll", "grp").distinct()), ["coll", "grp"], "left_semi").select("coll", "grp", F.col("first_id").alias("own_id"))
    met = groups.select("coll", "first_id").join(F.broadcast(own), "coll")
    found = met.groupBy("coll", "grp").agg(F.max(F.when(F.col("first_id") < F.col("own_id"), F.col("first_id"))).alias("previous"), F.min(F.when(F.col("first_id") > F.col("own_id"), F.col("first_id"))).alias("next"))
    return found.select("coll", "grp", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


def group_of(passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(passage_id, coll, grp) of wanted passage ids."""
    return passages.select("passage_id", "coll", "grp").join(wanted.select("passage_id"), "passage_id")


def read_group(index: IndexTables, passage_id: int) -> DataFrame:
    """Every passage of the group that holds ``passage_id``, with title and the neighbouring groups' starts."""
    own = index.passages.filter(F.col("passage_id") == passage_id).select("coll", "grp")
    return index.passages.join(F.broadcast(neighbours(index.groups, own)), ["coll", "grp"]).join(index.titles, "passage_id", "left").select("passage_id", "coll", "grp", "num", "text", "title", "previous", "next")


def window(passages: DataFrame, groups: DataFrame, wanted: DataFrame, reach: int = 3) -> DataFrame:
    """(asked, passage_id, num, text): passages within ``reach`` of each wanted one, clipped to its group.

    The wanted ids' ranges are spread into single ids, so the join is by equality.
    """
    own = group_of(passages, wanted).join(groups, ["coll", "grp"])
    near = own.select(F.col("passage_id").alias("asked"), F.explode(F.sequence(F.greatest(F.col("passage_id") - reach, F.col("first_id")), F.least(F.col("passage_id") + reach, F.col("end_id") - 1))).alias("passage_id"))
    return near.join(passages.select("passage_id", "num", "text"), "passage_id")


def step(groups: DataFrame, by: int) -> DataFrame:
    """(coll, first_id, stepped): the group ``by`` groups on, clamped to the ends of the collection."""
    placed = durable(renumbered(groups).select("coll", "first_id", "ordinal"))
    last = placed.groupBy("coll").agg(F.max("ordinal").alias("last"))
    to = placed.join(last, "coll").withColumn("to", F.least(F.greatest(F.col("ordinal") + by, F.lit(1)), F.col("last")).cast("int"))
    return to.select("coll", "first_id", F.col("to").alias("ordinal")).join(placed.select("coll", "ordinal", F.col("first_id").alias("stepped")), ["coll", "ordinal"]).select("coll", "first_id", "stepped")


def step_passage(passages: DataFrame, groups: DataFrame, wanted: DataFrame, by: int) -> DataFrame:
    """(passage_id, stepped): the passage ``by`` passages on, clamped to the collection's first and last."""
    ends = groups.groupBy("coll").agg(F.min("first_id").alias("low"), (F.max("end_id") - 1).alias("high"))
    own = group_of(passages, wanted).join(F.broadcast(ends), "coll")
    return own.select("passage_id", F.least(F.greatest(F.col("passage_id") + by, F.col("low")), F.col("high")).alias("stepped"))


def reference(name: Column, grp: Column, num: Column, span: Column | None = None) -> Column:
    """``Name 3:16``, or ``Name 3:16-18`` for a run."""
    one = F.concat(name, F.lit(" "), grp.cast("string"), F.lit(":"), num.cast("string"))
    return one if span is None else F.when(span == 1, one).otherwise(F.concat(one, F.lit("-"), (num + span - 1).cast("string")))


def lexicon_entries(index: IndexTables, codes: DataFrame, most: int = 16) -> DataFrame:
    """Lexicon fields, passages and occurrences, language, and the commonest renderings; missing fields are null."""
    best = index.renderings.filter(F.col("place") <= most).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("place", "norm", "n"))).alias("renderings"))
    used = index.frequencies.filter("kind = 'code'").select(F.col("target").alias("code"), "df", "cf")
    return codes.join(index.lexicon, "code", "left").join(used, "code", "left").join(best, "code", "left").withColumn("language", F.when(F.col("code").startswith("H"), "H").otherwise("G"))


def cross_links(lexicon: DataFrame) -> DataFrame:
    """(code, other): codes that a derivation names."""
    found = lexicon.select("code", F.explode(F.regexp_extract_all("derivation", F.lit(r"\b[HG]0*\d{1,4}\b"), F.lit(0))).alias("raw"))
    return found.select("code", F.regexp_replace("raw", "^([HG])0*", "$1").alias("other")).distinct()


def contents(groups: DataFrame) -> DataFrame:
    """(coll, groups, first_id) of each collection."""
    return groups.groupBy("coll").agg(F.count(F.lit(1)).alias("groups"), F.min("first_id").alias("first_id"))


def renumbered(groups: DataFrame) -> DataFrame:
    """Groups with their running number inside the collection, from 1; ranked in quantile buckets, whatever a collection holds."""
    placed = durable(dense_ids(groups, ["first_id"], "_n", salt="coll"))
    return placed.withColumn("ordinal", (F.col("_n") + 1).cast("int")).drop("_n")


def address(code: Column, grp: Column, num: Column) -> Column:
    return F.concat_ws(".", code, grp.cast("string"), num.cast("string"))


def resolve_addresses(asked: DataFrame, index: IndexTables) -> DataFrame:
    """(address, passage_id) of ``CODE.grp.num`` strings; the number defaults to 1, and what does not exist is -1."""
    parts = asked.withColumn("p", F.split("address", r"\.")).select("address", F.get("p", F.lit(0)).alias("code"), F.expr("try_cast(get(p, 1) as bigint)").alias("grp"), F.coalesce(F.expr("try_cast(get(p, 2) as int)"), F.lit(1)).alias("num"))
    known = index.passages.join(index.collections.select("coll", "code"), "coll").select("code", F.col("grp").cast("bigint").alias("grp"), F.col("num").cast("int").alias("num"), "passage_id")
    return parts.join(known, ["code", "grp", "num"], "left").select("address", F.coalesce("passage_id", F.lit(-1)).alias("passage_id"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def chapter_json(index: IndexTables, passage_id: int) -> DataFrame:
    """One row: the group that holds a passage, with name, title, neighbours, and its passages in order, as JSON."""
    rows = read_group(index, passage_id).join(F.broadcast(index.collections.select("coll", "name")), "coll")
    verses = F.transform(F.array_sort(F.collect_list(F.struct(F.col("passage_id").alias("id"), F.col("num").alias("v"), "text", "title"))), lambda v: v)
    whole = rows.groupBy("coll", "grp", "name", "previous", "next").agg(verses.alias("verses"))
    shown = F.struct(F.concat_ws(" ", "name", "grp").alias("name"), F.get("verses", F.lit(0))["title"].alias("title"), F.col("previous").alias("prev"), "next", F.transform("verses", lambda v: v.dropFields("title")).alias("verses"))
    return whole.select(F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def lexicon_json(index: IndexTables, codes: DataFrame) -> DataFrame:
    """(code, json) of each code that the lexicon has, with passages, uses, language and renderings."""
    rows = lexicon_entries(index, codes.join(F.broadcast(index.lexicon.select("code")), "code", "left_semi"))
    shown = F.struct("code", "lemma", "translit", "pron", "derivation", "definition", "usage", F.coalesce("df", F.lit(0)).alias("verses"), F.coalesce("cf", F.lit(0)).alias("uses"), F.when(F.col("language") == "G", "greek").otherwise("hebrew").alias("lang"), F.transform(F.coalesce("renderings", F.array().cast("array<struct<place:int,norm:string,n:bigint>>")), lambda r: F.struct(r["norm"].alias("word"), r["n"].alias("n"))).alias("renderings"))
    return rows.select("code", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def metadata(index: IndexTables) -> dict[str, DataFrame]:
    """What a reader of the whole index needs besides single passages, as tables, since the texts have no bound.

    collections (coll, code, name, short), groups (coll, grp, first_id), titles (passage_id, title), texts (passage_id, text).
    """
    return {
        "collections": index.collections.select("coll", "code", "name", "short"), "groups": index.groups.select("coll", "grp", "first_id"),
        "titles": index.titles, "texts": index.passages.select("passage_id", "text"),
    }
