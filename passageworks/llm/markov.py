"""Secret scans: base patterns, and Markov models of random strings against ordinary identifiers.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.common import clean

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The whole run is one match, so the least length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: A string that the models judge: a run of base64 and identifier characters, as long as an assigned secret. LEAST_LLR decides from there.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: Shorter runs without a letter are numbers and dates, which the ordinary sample (words without digits) does not know.
LONG = 20
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
CLASSES = len(ALPHABET)
SMOOTH = 0.5
#: Natural log of the odds that a candidate must overcome: one secret in about three million candidates.
LEAST_LLR = 15.0
#: And for each character pair, so that long paths of plain words do not add up to a secret.
LEAST_PER_PAIR = 1.0
#: The fitting sample: so many generated random strings, and the words of about so many documents.
RANDOM_STRINGS, SAMPLE_DOCS = 20_000, 2_000
BLOCK = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_fold(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``both`` (0 is neutral to it) over an int array, in blocks so that long arrays take near-linear time."""
    zero, none = F.lit(0), F.array().cast("array<int>")
    blocks = F.transform(F.sequence(zero, F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    whole = F.transform(blocks, lambda block: F.aggregate(block, zero, both))
    total = F.struct(zero.alias("at"), none.alias("out"))
    before = F.aggregate(whole, total, lambda a, v: F.struct(both(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def run(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), lambda a, v: F.struct(both(a["at"], v).alias("at"), F.concat(a["out"], F.array(both(a["at"], v))).alias("out")), lambda a: a["out"])

    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, before, run))).otherwise(none)


def prefix_sums(values: Column) -> Column:
    return prefix_fold(values, lambda a, v: a + v)


def meets_any(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of ``others``, which are in order and apart: bisection finds the last that starts before its end."""
    steps = F.array(*(F.lit(1 << k) for k in range(26, -1, -1)))
    below = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size(others)) & (F.get(others, low + step - 1)["start"] < span["end"]), low + step).otherwise(low))
    return F.coalesce(F.get(others, below - 1)["end"] > span["start"], F.lit(False))


def ends_of(text: Column, pattern: str, matches: Column) -> Column:
    """End offsets in code points of all matches: lengths of what lies between them, and of them, added up."""
    between = F.split(text, pattern, -1)
    return prefix_sums(F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, m: F.length(gap) + F.length(m)))


@dataclass
class MarkovSecrets:
    """Log-likelihood ratio of each character pair: random strings over ordinary identifiers."""

    ratios: list[float]

    def score(self, token: Column) -> Column:
        classes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        table = F.split(F.lit(",".join(f"{r:.6f}" for r in self.ratios)), ",").cast("array<double>")
        n = F.size(classes)
        pairs = F.zip_with(F.slice(classes, 1, n - 1), F.slice(classes, F.lit(2), n - 1), lambda a, b: F.get(table, a * CLASSES + b))
        return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)

    @classmethod
    def fit(cls, samples: DataFrame) -> MarkovSecrets:
        """From ``samples(token string, secret boolean)``; only pair counts (2 x classes^2 at most) reach the driver."""
        classes = samples.select("secret", F.filter(F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda k: k >= 0).alias("k")).filter(F.size("k") > 1)
        pairs = classes.select("secret", F.explode(F.arrays_zip(F.slice("k", 1, F.size("k") - 1).alias("a"), F.slice("k", F.lit(2), F.size("k") - 1).alias("b"))).alias("p"))
        counts = {True: [[SMOOTH] * CLASSES for _ in range(CLASSES)], False: [[SMOOTH] * CLASSES for _ in range(CLASSES)]}
        for row in pairs.groupBy("secret", "p.a", "p.b").count().collect():
            counts[row["secret"]][row["a"]][row["b"]] += row["count"]
        logs = {s: [[math.log(v / sum(line)) for v in line] for line in rows] for s, rows in counts.items()}
        return cls([logs[True][a][b] - logs[False][a][b] for a in range(CLASSES) for b in range(CLASSES)])


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", random_strings: int = RANDOM_STRINGS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token, secret): generated random strings in four alphabets, and digit-free words of a bounded sample of documents."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    packed = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    made = spark.range(random_strings).select(F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(digest)).when(F.col("id") % 4 == 2, packed).otherwise(F.translate(packed, "+/", "-_")).alias("token"), F.lit(True).alias("secret"))
    rate = min(1.0, sample_docs / max(1, docs.count()))
    picked = docs.filter(F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("sample")), F.lit(1_000_003)) < rate * 1_000_003)
    words = picked.select(F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[A-Za-z][A-Za-z_-]{5,}"), F.lit(0))).alias("token"), F.lit(False).alias("secret"))
    return made.union(words)


def scan(docs: DataFrame, model: MarkovSecrets, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least_llr: float = LEAST_LLR) -> DataFrame:
    """(doc_id, _text, found: array of (start, k, end, kind), ...keep) for every row, over whole texts.

    Base spans are the leftmost non-overlapping matches of each kind that pass its length; the models add
    candidates whose log-likelihood ratio reaches ``least_llr`` and LEAST_PER_PAIR a pair, and that touch no base span. Offsets are
    code points, end exclusive; spans are ordered by start, then kind (ties: in the order of KINDS). Null text counts as empty: no
    spans. Null ids and repeated rows: each is returned. Very long texts are scanned whole, in time near-linear in their spans.
    Other columns, of whatever name, are not read. Empty table: no rows.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    spans_type = "array<struct<start:int,k:int,end:int,kind:string>>"
    none = F.array().cast(spans_type)

    def spans(kind: str, matches: str, ends: Column) -> Column:
        k = KINDS.index(kind)
        return F.zip_with(F.col(matches), ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(k).alias("k"), e.alias("end"), F.lit(kind).alias("kind")))

    raw = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"), *(F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)))
    found = raw.select(
        "*",
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("_assign"),
        F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_access"),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("_hex"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_tokens"),
    )
    scored = found.withColumn("_high", F.transform("_tokens", lambda t: (model.score(t) >= F.greatest(F.lit(least_llr), LEAST_PER_PAIR * (F.length(t) - 1))) & ((F.length(t) >= LONG) | t.rlike("[A-Za-z]")) & ~t.rlike(f"{ACCESS}|{HEX}")))
    assign = F.filter(
        F.zip_with(F.arrays_zip(F.col("_assign").alias("m"), ends_of(text, ASSIGN, F.col("_assign")).alias("e")), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda z, value: F.struct((z["e"] - F.length(z["m"])).alias("start"), F.lit(0).alias("k"), z["e"].alias("end"), F.lit("assign").alias("kind"), F.length(value).alias("n"))),
        lambda s: s["n"] >= ASSIGN_LEAST,
    )
    assign = F.transform(assign, lambda s: F.struct(s["start"], s["k"], s["end"], s["kind"]))
    high = F.transform(F.filter(F.zip_with(spans("markov", "_tokens", ends_of(text, CANDIDATE, F.col("_tokens"))), F.col("_high"), lambda s, high: F.struct(s.alias("s"), high.alias("high"))), lambda z: z["high"]), lambda z: z["s"])
    based = scored.select(
        "*",
        F.when(F.size("_assign") > 0, assign.cast(spans_type)).otherwise(none).alias("_a"),
        F.when(F.size("_access") > 0, spans("access", "_access", ends_of(text, ACCESS, F.col("_access"))).cast(spans_type)).otherwise(none).alias("_k"),
        F.when(F.size("_hex") > 0, spans("hex", "_hex", ends_of(text, HEX, F.col("_hex"))).cast(spans_type)).otherwise(none).alias("_h"),
        F.when(F.exists("_high", lambda x: x), high.cast(spans_type)).otherwise(none).alias("_m"),
    )
    free = F.filter("_m", lambda m: ~meets_any(m, F.col("_a")))
    return based.select("doc_id", "_text", *(f"keep{i}" for i in range(len(keep))), F.array_sort(F.concat("_a", "_k", "_h", free)).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")


def counted(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan``'s rows."""
    base = F.filter("found", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *(number_of(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of touching spans, replaced by ``mark``; spans are ordered by start."""

    def cut(starts: Column, top: Column, first: Column) -> Column:
        """``first``: numbers of the spans that begin a run; a run reaches to the furthest end before the next one begins."""
        begins = F.concat(F.transform(first, lambda k: F.get(starts, k)), F.array(F.length(text)))
        last = F.transform(first, lambda k, j: F.get(top, F.coalesce(F.get(first, j + 1), F.size(top)) - 1))
        return F.array_join(F.zip_with(F.concat(F.array(F.lit(0)), last), begins, lambda a, b: F.substring(text, a + 1, b - a)), mark)

    def runs(starts: Column, top: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(top) - 1), lambda k: (k == 0) | (F.get(starts, k) > F.get(top, k - 1)))
        return let(first, lambda f: cut(starts, top, f))

    starts, ends = F.transform(found, lambda s: s["start"]), F.transform(found, lambda s: s["end"])
    both = let(F.struct(starts.alias("starts"), prefix_fold(ends, lambda a, v: F.greatest(a, v)).alias("top")), lambda x: runs(x["starts"], x["top"]))
    return F.when(F.size(found) > 0, both).otherwise(text)


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MarkovSecrets:
    return MarkovSecrets.fit(labelled_samples(clean(docs, id_col, text_col), id_col, text_col))
