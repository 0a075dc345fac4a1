"""Distances by pieces bound the exact ones from above, and lines' words add up where they are."""

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from quantloom.llm import fuzzy_lines


def test_pieces_bound_the_distance(spark):
    rng, rows = random.Random(2), []
    for n in (1, 5, 31, 32, 33, 64, 200, 700):
        for changes in (0, 1, 3, n // 6, n // 2):
            a = [chr(0x4E00 + rng.randrange(20_000)) for _ in range(n)]
            b = a.copy()
            for _ in range(changes):
                b[rng.randrange(len(b))] = chr(0x4E00 + rng.randrange(20_000))
            rows += [("".join(a), "".join(b), n // 5), ("".join(a), "".join(b[1:]), n // 5), ("".join(b), "".join([*a, "x", "y"]), n // 5)]
    df = spark.createDataFrame(rows, "a string, b string, most int")
    got = df.select("a", "b", "most", fuzzy_lines._by_pieces("a", "b", "most").alias("bound"), F.levenshtein("a", "b").alias("d")).collect()
    assert all(r.bound >= r.d for r in got if r.bound <= r.most) and all(r.bound > r.most for r in got if r.d > r.most)
    even = [r for r in got if len(r.a) == len(r.b) and 0 < r.d <= r.most]
    assert len(even) > 10 and all(r.bound <= r.most for r in even)


def test_words_of_a_line_are_added_up_without_a_second_shuffle(spark):
    docs = spark.createDataFrame([(1, "one two three four five six\nseven eight nine ten eleven")], "doc_id long, text string")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        fuzzy_lines.occurrences(docs).explain()
    assert len(re.findall(r"Exchange hashpartitioning", out.getvalue())) == 1
    assert "REPARTITION_BY_COL" in out.getvalue()
