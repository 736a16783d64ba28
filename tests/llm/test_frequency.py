import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import frequency
from tests.conftest import rows


def brute(data, lengths=None):
    occurrences, records = Counter(), defaultdict(set)
    for record, *values in data:
        for field, tokens in zip("fg", values, strict=True):
            for n in lengths or range(1, len(tokens or []) + 1):
                for k in range(len(tokens or []) - n + 1):
                    gram = tuple(tokens[k : k + n])
                    if None in gram:
                        continue
                    occurrences[field, gram] += 1
                    if record is not None:
                        records[field, gram].add(record)
    return sorted(((f, list(g), len(g), c, len(records[f, g])) for (f, g), c in occurrences.items()), key=str)


@pytest.mark.parametrize(("lengths", "block_tokens", "split_rows"), [(None, 100_000, 1000), (None, 40, 1000), ([1], 1, 10), ([2, 5], 40, 10), (None, 100_000, 10)])
def test_all_ngrams_equal_brute_force(spark, lengths, block_tokens, split_rows):
    r = random.Random(7)
    words = ["hot"] * 5 + list("abcd") + ["", None, "x" * 5000]
    value = lambda: r.choice([None, [r.choice(words) for _ in range(r.randrange(8))]])
    data = [(r.choice(["big"] * 4 + [f"r{k}" for k in range(9)] + [None]), value(), value()) for _ in range(120)]
    data += data[:20] + [("r1", None, ["a"] * 70)]
    df = spark.createDataFrame(data, "record string, a array<string>, b array<string>").repartition(3)
    got = frequency.ngram_frequencies(df, record=F.col("record"), values={"f": F.col("a"), "g": F.col("b")}, lengths=lengths, block_tokens=block_tokens, split_rows=split_rows)
    assert rows(got, "field_name", "gram", "n", "occurrences", "records") == brute(data, lengths)


def test_suffix_array_and_common_prefixes():
    r = random.Random(3)
    for size in (1, 2, 7, 40):
        values = [[r.choice("ab") for _ in range(r.randrange(1, size + 1))] for _ in range(6)] + [list("abababab")] * 2
        code = np.array([ord(c) for v in values for c in v])
        rest = np.array([len(v) - k for v in values for k in range(len(v))])
        record = np.array([i for i, v in enumerate(values) for _ in v])
        order, common = frequency.suffix_array(code, rest, record)
        suffixes = ["".join(map(chr, code[i : i + rest[i]])) for i in order]
        assert suffixes == sorted(suffixes)
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert common.tolist() == shared


def test_duplicates_within_a_record_are_subtracted():
    """a b a b / a b: "a b" stands three times in two records; without the subtraction it would be in three."""
    code, rest, record = np.array([0, 1, 0, 1, 0, 1]), np.array([4, 3, 2, 1, 2, 1]), np.array([0, 0, 0, 0, 1, 1])
    order, common = frequency.suffix_array(code, rest, record)
    first, occurrences, records = frequency.interval_counts(order, common, rest, record, 2)
    assert sorted(zip(code[first].tolist(), occurrences.tolist(), records.tolist(), strict=True)) == [(0, 3, 2), (1, 1, 1)]


def test_marks_values_and_limits(spark):
    data = [(f"S{k}", "common" if k < 6 else " Edge " if k < 11 else f"v{k}", None) for k in range(100)]
    data += [("S0", "COMMON", "?"), ("S1", "pair", ""), ("S1", "Pair ", " "), (None, "pair", None)]
    df = spark.createDataFrame(data, "s string, a string, b string").withColumns({"mark": F.lit(1), "term": F.lit("x"), "record": F.lit(2), "v0": F.lit(3)})
    for split_rows in (1000, 1):
        got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in frequency.marked_terms(df, record_col="s", fields=["a", "b"], split_rows=split_rows).collect()}
        # 5 of 100 records is not more than 5 %; a pair of rows of one record is one record.
        assert got["COMMON"] == (7, 6, "too_common") and got["EDGE"] == (5, 5, "useful") and got["PAIR"] == (3, 1, "too_rare") and got["V20"] == (1, 1, "too_rare")
        assert not {"?", "", None} & set(got)
    assert frequency.marked_terms(df.limit(0), record_col="s", fields=["a"]).count() == 0
