"""Build an index from a folder of marked text, lexicon and synonym lists, and say what it holds.

``python -m passageworks.build_index DATA_DIR OUT_DIR``
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from passageworks.operators import index
from passageworks.sources import marked


def build(spark: SparkSession, data: str, out: str) -> dict[str, int]:
    """Read text.tsv, lexicon.tsv, weighted.tsv and hand.tsv of ``data``, write the index tables to ``out``, and return their counts."""
    known = marked.collections(spark)
    passages, titles = marked.read_marked(spark, f"{data}/text.tsv", known)
    synonyms = marked.read_weighted_synonyms(spark, f"{data}/weighted.tsv").union(marked.read_hand_synonyms(spark, f"{data}/hand.tsv"))
    built = index.build(passages, tokens=index.marked_tokens(passages), lexicon=marked.read_lexicon(spark, f"{data}/lexicon.tsv"), synonym_sources=synonyms, titles=titles, collections=known, scopes=marked.scopes(spark))
    built.write(out)
    own = index.IndexTables.read(spark, out)
    return {
        "passages": own.passages.count(), "words": own.tokens.count(), "surface forms": own.vocab.count(),
        "stems": own.vocab.select("stem").distinct().count(), "synonym keys": own.synonyms.select("stem").distinct().count(),
    }


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print("usage: python -m passageworks.build_index DATA_DIR OUT_DIR", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    print(", ".join(f"{n} {name}" for name, n in build(spark, *arguments).items()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
