"""Term frequencies and distinctive terms against brute force."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from loomsearch.llm import distinctive, frequencies
from loomsearch.llm.common import materialise


def test_posting_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["Ab", " ab ", "c", "D", None, "é"]), rng.randrange(12), [rng.randrange(9) for _ in range(3)], "x") for _ in range(200)]
    rows += rows[:20] + [("only", 1, None, "x"), ("far", 99, [1], "x")]
    records = spark.createDataFrame([(i, "clash") for i in [*range(10), 3]] + [(None, "n")], "doc_id long, term string")
    pairs = materialise(frequencies.posting_pairs(spark.createDataFrame(rows, "term string, doc_id long, positions array<int>, source string"), records), "p")
    got = {r.term: (r.n_records, r.n_occurrences) for r in frequencies.frequencies(materialise(frequencies.pair_partials(pairs), "q")).collect()}
    seen = collections.defaultdict(set)
    for term, doc, places, _ in rows:
        if term is not None and doc < 10:
            seen[term.strip(" ").lower(), doc] |= set(places or ())
    want = collections.defaultdict(lambda: [0, 0])
    for (term, _), places in seen.items():
        want[term][0] += 1
        want[term][1] += len(places)
    assert got == {k: tuple(v) for k, v in want.items()}
    none = frequencies.frequencies(materialise(frequencies.pair_partials(pairs.limit(0)), "e"))
    assert none.count() == 0


def test_dictionary_is_dense_and_ordered(spark):
    words = spark.createDataFrame([(f"w{i:05d}",) for i in range(5000)], "term string").repartition(7)
    rows = frequencies.dictionary(words).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(5000)) and [r.term for r in rows] == sorted(r.term for r in rows)


def test_marks(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (30,), (29,)], "d long").select("d", frequencies.mark(F.col("d"), F.lit(100)).alias("m")).collect()
    assert {r.d: r.m for r in rows} == {1: "rare", 2: "rare", 3: None, 30: "common", 29: None}


def test_distinctive_terms(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"title {i}", " ".join(rng.choices(["the", "of", "bank", "river", "Word_1", "x"], [30, 20, 3, 2, 1, 1], k=40)), None) for i in range(30)]
    rows[4] = (4, "special", "the special special river of the special", None)
    rows += [(50, None, None, None), (51, "", "...", None)]
    texts = distinctive.record_text(spark.createDataFrame(rows, "doc_id long, title string, content string, text string"))
    got = {r.doc_id: (r.term, r.score) for r in distinctive.top_terms(distinctive.scored_terms(texts)).collect()}
    counts = {i: collections.Counter(re.findall(r"\w+", f"{t or ''}\n{c or ''}".lower())) for i, t, c, _ in rows}
    cf = sum(counts.values(), collections.Counter())
    total = cf.total()

    def score(tf, length, c):
        def part(o, e):
            return o * math.log(o / e) if o else 0.0

        value = 2 * (part(tf, length * c / total) + part(length - tf, length * (total - c) / total) + part(c - tf, (total - length) * c / total) + part(total - length - c + tf, (total - length) * (total - c) / total))
        return value if tf * (total - length) >= (c - tf) * length else -value

    for doc, own in counts.items():
        if own:
            best = max(score(n, own.total(), cf[t]) for t, n in own.items())
            assert math.isclose(got[doc][1], best, rel_tol=1e-9, abs_tol=1e-9)
    assert got[4][0] == "special" and 50 not in got and 51 not in got
    probes = spark.createDataFrame([(4,), (4,), (None,), (77,)], "doc_id long")
    assert [r.doc_id for r in distinctive.top_terms(distinctive.scored_terms(texts, probes)).collect()] == [4]
    assert distinctive.scored_terms(texts.limit(0)).count() == 0
    for share in (1e-5, 0.05):  # with all terms known to the workers, and with a rare rest
        monkeypatch.setattr(distinctive, "KNOWN_SHARE", share)
        best = {(r.doc_id, r["rank"]): (r.term, round(r.score, 6)) for r in distinctive.best_terms(texts, 3).collect()}
        assert best == {(r.doc_id, r["rank"]): (r.term, round(r.score, 6)) for r in distinctive.top_terms(distinctive.scored_terms(texts).withColumn("score", F.round("score", 9)), 3).collect()}
