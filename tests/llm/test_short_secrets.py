"""Random strings shorter than twenty characters, outside assignments."""

from __future__ import annotations

import random
import string

from passageworks.llm import markov


def test_short_random_strings_are_judged(spark):
    model = markov.fit_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(4)
    made = [(n, f"see {''.join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))} end") for n in (12, 14, 16, 18) for _ in range(50)]
    plain = [(0, t) for t in ("see internationalization end", "see some_plain_name end", "see well-established end", "see at 2024-01-15-10 end", "see card 4111-1111-1111-1111 end", "see 20240115123456 end", "see 555-123-4567 end")]
    found = markov.counted(markov.scan(spark.createDataFrame(made + plain, "doc_id int, text string"), model)).collect()
    hits = {n: [r["spans"] for r in found if r["doc_id"] == n] for n in (0, 12, 14, 16, 18)}
    for n in (12, 14, 16, 18):
        assert sum("markov" in s for s in hits[n]) >= 45
    assert not any(hits[0]), hits[0]
