"""Index tables: tokens, vocabulary, postings, concept shares, renderings, synonyms, groups."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passageworks.functions.durable import bounded, durable
from passageworks.functions.text import is_stop, normalize, stem, words

ITALIC, RED = 1, 2
TF_MOST = 255
SHARE_LEAST, SHARES = 0.05, 6
SYNONYMS = 12
#: Tables that ``build`` writes as it goes, since the others are worked out from them.
WRITTEN = ("passages", "tokens", "vocab", "postings")


def tokenize(passages: DataFrame) -> DataFrame:
    """(passage_id, pos, surface, norm): every word of every passage."""
    # the outer form, as the plain one would find the words twice: once for a filter on their number
    each = passages.select("passage_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "surface")).filter("pos is not null")
    return each.withColumn("norm", normalize(F.col("surface")))


def stems(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("stem", stem(F.col("norm")))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(norm, stem, n): distinct words, each stemmed once."""
    return tokens.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", stem(F.col("norm")))


def lengths(passages: DataFrame) -> DataFrame:
    """(passage_id, group_id, coll, dl) of every passage, those without words included."""
    return passages.select("passage_id", "coll", "grp", "num", F.size(words(F.col("text"))).alias("dl"))


def corpus_size(lengths: DataFrame) -> tuple[int, float]:
    """(passages, mean words of a passage); passages without words count."""
    row = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).first()
    return row["n"], (row["words"] or 0) / max(1, row["n"]) or 1.0


def forms_of(tokens: DataFrame, stems_: list[str]) -> DataFrame:
    """(norm, stem) of the distinct words whose stem is one of a few: each is stemmed once, and they are few enough to send."""
    return bounded(tokens.select("norm").distinct().withColumn("stem", stem(F.col("norm"))).filter(F.col("stem").isin(stems_)))


def postings_of(tokens: DataFrame, stems_: list[str]) -> DataFrame:
    """Postings of a few stems alone: other words go before anything is shuffled."""
    kept = tokens.select("passage_id", "norm").join(F.broadcast(forms_of(tokens, stems_)), "norm")
    summed = kept.groupBy("passage_id", "stem").agg(F.count(F.lit(1)).alias("n"))
    return summed.select(F.lit("stem").alias("kind"), F.col("stem").alias("target"), "passage_id", F.least("n", F.lit(TF_MOST)).cast("int").alias("tf"))


def stem_postings(tokens: DataFrame) -> DataFrame:
    """(kind, target, passage_id, tf): occurrences of each stem, at most TF_MOST.

    Words without a known stem are counted by surface form first, so the stem is worked out once for each word of a passage.
    """
    if "stem" in tokens.columns:
        summed = tokens.groupBy("passage_id", "stem").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = tokens.groupBy("passage_id", "norm").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", stem(F.col("norm")))
        summed = counted.groupBy("passage_id", "stem").agg(F.sum("n").alias("n"))
    return summed.select(F.lit("stem").alias("kind"), F.col("stem").alias("target"), "passage_id", F.least("n", F.lit(TF_MOST)).cast("int").alias("tf"))


def code_postings(tokens: DataFrame) -> DataFrame:
    """(kind, target, passage_id, tf) of concept codes; ``tokens`` has codes array<string>."""
    each = tokens.select("passage_id", F.explode("codes").alias("target"))
    return each.groupBy("target", "passage_id").agg(F.least(F.count(F.lit(1)), F.lit(TF_MOST)).cast("int").alias("tf")).select(F.lit("code").alias("kind"), "target", "passage_id", "tf")


def frequencies(postings: DataFrame) -> DataFrame:
    """(kind, target, df, cf)."""
    return postings.groupBy("kind", "target").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def code_order(code: Column) -> list[Column]:
    """H before G, then by number."""
    return [F.when(F.substring(code, 1, 1) == "H", 0).otherwise(1), F.substring(code, 2, 9).cast("int")]


def stem_codes(tokens: DataFrame) -> DataFrame:
    """(stem, code, share): at most six codes of a stem's occurrences, share of 255, from a twentieth up."""
    total = tokens.groupBy("stem").agg(F.count(F.lit(1)).alias("total"))
    pairs = tokens.select("stem", F.explode("codes").alias("code")).groupBy("stem", "code").agg(F.count(F.lit(1)).alias("k"))
    shared = pairs.join(total, "stem").filter(F.col("k") / F.col("total") >= SHARE_LEAST).withColumn("share", F.floor(F.col("k") / F.col("total") * 255 + 0.5).cast("int"))
    place = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("share"), *code_order(F.col("code"))))
    return shared.withColumn("place", place).filter(F.col("place") <= SHARES).select("stem", "code", "share", "place")


def renderings(tokens: DataFrame) -> DataFrame:
    """(code, norm, n, place): how each code is rendered, most frequent first."""
    counted = tokens.select("norm", F.explode("codes").alias("code")).groupBy("code", "norm").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "norm")))


def transliterations(lexicon: DataFrame, vocab: DataFrame, postings: DataFrame) -> DataFrame:
    """(norm, codes): transliterations of three letters or more that are no word of the text, of codes that occur."""
    names = lexicon.select("code", normalize(F.col("translit")).alias("norm")).filter(F.length("norm") >= 3)
    used = postings.filter("kind = 'code'").select(F.col("target").alias("code")).distinct()
    free = names.join(used, "code", "left_semi").join(vocab.select("norm"), "norm", "left_anti")
    return free.groupBy("norm").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def synonyms(sources: DataFrame, vocab: DataFrame) -> DataFrame:
    """(stem, target, weight, place): at most twelve stems of the text for each key, heaviest first.

    ``sources`` has (key, word, weight). Of equal weights the stem whose first word sorts first leads.
    """
    known = vocab.filter("norm <> ''").groupBy(F.col("stem").alias("target")).agg(F.min("norm").alias("least"))
    pairs = sources.select(stem(normalize(F.col("key"))).alias("stem"), stem(normalize(F.col("word"))).alias("target"), "weight")
    good = pairs.filter((F.col("target") != F.col("stem")) & ~is_stop(F.col("target"))).groupBy("stem", "target").agg(F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("weight"), "least"))
    return good.join(known, "target").withColumn("place", place).filter(F.col("place") <= SYNONYMS).select("stem", "target", "weight", "place")


def groups(passages: DataFrame) -> DataFrame:
    """(coll, grp, first_id, end_id): the run of passages of each group."""
    return passages.groupBy("coll", "grp").agg(F.min("passage_id").alias("first_id"), (F.max("passage_id") + 1).alias("end_id"))


def marked_tokens(passages: DataFrame) -> DataFrame:
    """Tokens of marked passages with flags and codes.

    A flag or tag covers a word whose start lies inside it. A function word gets a tag's codes only if the tag
    holds no other kind of word.
    """
    offsets = passages.select("*", words(F.col("text")).alias("_w"), F.split("text", r"\p{IsAlphabetic}+(?:['’-]\p{IsAlphabetic}+)*", -1).alias("_gaps"))
    step = lambda acc, z: F.struct((acc["at"] + F.length(z["g"]) + F.length(z["w"])).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(z["g"]))).alias("out"))
    starts = F.aggregate(F.zip_with(F.slice("_gaps", 1, F.size("_w")), "_w", lambda g, w: F.struct(g.alias("g"), w.alias("w"))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])
    each = offsets.withColumn("_s", starts).select("passage_id", "spans", "italic", "red", F.posexplode(F.zip_with("_w", "_s", lambda w, s: F.struct(w.alias("w"), s.alias("s")))).alias("pos", "z"))
    inside = lambda r: (r["start"] <= F.col("z.s")) & (F.col("z.s") < r["end"])
    tagged = each.select(
        "passage_id", "pos", F.col("z.w").alias("surface"), F.col("z.s").alias("start"), (F.col("z.s") + F.length("z.w")).alias("end"), normalize(F.col("z.w")).alias("norm"),
        (F.when(F.exists("italic", inside), ITALIC).otherwise(0) + F.when(F.exists("red", inside), RED).otherwise(0)).cast("tinyint").alias("flags"),
        F.get(F.filter(F.transform("spans", lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end"), s["codes"].alias("codes"))), inside), F.lit(0)).alias("span"),
    ).withColumn("stem", stem(F.col("norm")))
    content = F.max((~is_stop(F.col("stem"))).cast("int")).over(Window.partitionBy("passage_id", "span.i")) == 1
    gets = F.col("span").isNotNull() & (~is_stop(F.col("stem")) | ~content)
    return tagged.withColumn("codes", F.when(gets, F.col("span.codes")).otherwise(F.array().cast("array<string>"))).drop("span")


def synthetic_codes(tokens: DataFrame) -> DataFrame:
    """A code for each word from its own length and its stem's, for tables without concept tags."""
    return tokens.withColumn("codes", F.array(F.concat(F.lit("G"), (F.length("norm") * 10 + F.length("stem")).cast("string"))))


@dataclass
class IndexTables:
    """Everything that search, explanation and browsing read."""

    passages: DataFrame
    tokens: DataFrame
    lengths: DataFrame
    vocab: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    stem_codes: DataFrame
    renderings: DataFrame
    transliterations: DataFrame
    synonyms: DataFrame
    groups: DataFrame
    lexicon: DataFrame
    titles: DataFrame
    collections: DataFrame
    scopes: DataFrame

    def write(self, path: str) -> None:
        """Parquet, postings sorted by target so that a scan skips row groups."""
        for f in fields(self):
            df = getattr(self, f.name)
            if f.name == "postings":
                df = by_target(df)
            df.write.mode("overwrite").parquet(f"{path}/{f.name}")

    def stored(self) -> IndexTables:
        """The tables that ``build`` left as plans written once too, as every search reads most of them."""
        open_ = [f.name for f in fields(self) if f.name not in WRITTEN]
        with ThreadPoolExecutor(4) as pool:
            return replace(self, **dict(zip(open_, pool.map(lambda name: durable(getattr(self, name)), open_), strict=True)))

    def on_demand(self) -> IndexTables:
        """Like ``stored``, but each table is written when it is first read: a search leaves most of them alone."""
        return OnDemand(**{f.name: getattr(self, f.name) for f in fields(self)})

    @cached_property
    def size(self) -> tuple[int, float]:
        """(passages, mean words of a passage), counted once."""
        return corpus_size(self.lengths)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> IndexTables:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})


class OnDemand(IndexTables):
    """Tables that ``build`` left as plans are written once, by whichever operator reads them first."""

    def __getattribute__(self, name: str):
        own = object.__getattribute__(self, "__dict__")
        if name in own and name in IndexTables.__dataclass_fields__ and name not in WRITTEN and name not in own.setdefault("_stored", set()):
            own[name] = durable(own[name])
            own["_stored"].add(name)
        return object.__getattribute__(self, name)


def by_target(postings: DataFrame) -> DataFrame:
    return postings.repartitionByRange("target").sortWithinPartitions("target", "passage_id")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


LEXICON = "code string, lemma string, translit string, pron string, derivation string, definition string, usage string"


def build(passages: DataFrame, *, tokens: DataFrame | None = None, lexicon: DataFrame | None = None, synonym_sources: DataFrame | None = None, titles: DataFrame | None = None, collections: DataFrame | None = None, scopes: DataFrame | None = None) -> IndexTables:
    """Index of passages (passage_id, coll, grp, num, text); tokens carry codes if given."""
    spark = passages.sparkSession
    passages = durable(passages)
    kind = dict(passages.dtypes)["coll"]
    plain = tokens if tokens is not None else stems(tokenize(passages)).withColumn("codes", F.array().cast("array<string>")).withColumn("flags", F.lit(0).cast("tinyint"))
    plain = durable(plain)
    vocab = vocabulary(plain)
    postings = stem_postings(plain)
    if tokens is not None:
        postings = postings.union(code_postings(plain))
    vocab, postings = durable(vocab), durable(by_target(postings))
    lexicon = lexicon if lexicon is not None else empty(spark, LEXICON)
    sources = synonym_sources if synonym_sources is not None else empty(spark, "key string, word string, weight int")
    names = passages.select("coll").distinct().select("coll", F.col("coll").cast("string").alias("code"), F.col("coll").cast("string").alias("name"), F.col("coll").cast("string").alias("short"), F.array().cast("array<string>").alias("aliases"))
    return IndexTables(
        passages, plain, lengths(passages), vocab, postings, frequencies(postings), stem_codes(plain), renderings(plain), transliterations(lexicon, vocab, postings), synonyms(sources, vocab), groups(passages), lexicon,
        titles if titles is not None else empty(spark, "passage_id bigint, title string"), collections if collections is not None else names, scopes if scopes is not None else empty(spark, f"scope string, coll {kind}"),
    )
