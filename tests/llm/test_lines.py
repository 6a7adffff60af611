"""Repeated lines against brute force, and the operator's edge cases."""

import collections
import re

import pytest

from loomsearch.llm import common, lines
from loomsearch.llm.common import materialise

SCHEMA = "doc_id long, source string, content string, text string"


def brute_normal(line):
    line = re.sub(r"\s+", " ", re.sub(r"\d", "", line.lower()))
    at = [i for i, c in enumerate(line) if c.isalpha()]
    return line[at[0] : at[-1] + 1] if at else ""


def brute_found(rows):
    total = collections.Counter(s or "" for _, s, _, _ in rows)
    seen = collections.defaultdict(set)
    for doc, source, content, _ in rows:
        for line in (content or "").split("\n"):
            if brute_normal(line):
                seen[source or "", brute_normal(line)].add(doc)
    heavy = {k for k, v in seen.items() if len(v) >= 5 and len(v) >= 0.02 * total[k[0]]}
    return {(doc, n) for doc, source, content, _ in rows for n, line in enumerate((content or "").split("\n"), 1) if (source or "", brute_normal(line)) in heavy}


def rows_of(n=300):
    out = []
    for i in range(n):
        source = ("a", "a", "b", None)[i % 4]
        body = [f"Story {i} tells a thing of its own number {chr(97 + i % 26)}{chr(97 + i // 26)}."]
        if i % 3 == 0:
            body.append(f"  >> Share  this {i}   story 12!")
        if i % 40 == 0:
            body.append("Rare notice")
        body += ["", "12 34", "Legal notice"] if source == "b" else []
        out.append((i, source, "\n".join(body), "clash"))
    return [*out, (900, "a", None, None), (901, "a", "", None), (902, None, "x" * 50_000, None), (903, "b", "Legal notice\nLegal notice", None)]


@pytest.mark.parametrize("summary_size", [2, 4096])
def test_found_equals_brute_force(spark, summary_size):
    rows = rows_of()
    keys = materialise(lines.line_keys(spark.createDataFrame(rows, SCHEMA).repartition(3)), "k")
    repeated = materialise(lines.repeated_lines(keys, summary_size=summary_size), "r")
    got = {tuple(r) for r in lines.occurrences(keys, repeated).collect()}
    assert got == brute_found(rows)
    assert got


def test_cleaning_keeps_the_rest(spark):
    frame = spark.createDataFrame(rows_of(), SCHEMA)
    keys = materialise(lines.line_keys(frame), "k")
    repeated = materialise(lines.repeated_lines(keys), "r")
    clean = {r.doc_id: r for r in lines.without_repeated_lines(frame, repeated).collect()}
    assert clean[900].content is None and clean[900].n_removed == 0
    assert clean[903].content == "" and clean[903].n_removed == 2
    assert all("Share" not in (r.content or "") for r in clean.values())


def test_more_lines_than_are_broadcast_at_once(spark, monkeypatch):
    # sources are taken in parts, and give the same
    rows = rows_of()
    frame = spark.createDataFrame(rows, SCHEMA)
    keys = materialise(lines.line_keys(frame), "k")
    clean = lambda repeated: {(r.doc_id, r.content, r.n_removed) for r in lines.without_repeated_lines(frame, repeated).collect()}
    want = clean(materialise(lines.repeated_lines(keys), "r"))
    sizes = []

    def parts_of(df, by):
        parts = common.parts_of(df, by, 1)
        sizes.append(len(parts))
        return parts

    monkeypatch.setattr(lines, "parts_of", parts_of)
    repeated = materialise(lines.repeated_lines(keys), "r")
    assert {tuple(r) for r in lines.occurrences(keys, repeated).collect()} == brute_found(rows)
    assert clean(repeated) == want and max(sizes) > 1


def test_empty_table(spark):
    keys = materialise(lines.line_keys(spark.createDataFrame([], SCHEMA)), "k")
    assert lines.occurrences(keys, materialise(lines.repeated_lines(keys), "r")).count() == 0


@pytest.mark.parametrize(("line", "normal"), [("  ** A1b  C 7 ..", "ab c"), ("123 --", ""), ("", ""), ("Été 2", "été")])
def test_normal_line(line, normal):
    assert lines.normal_line(line) == normal == brute_normal(line)
