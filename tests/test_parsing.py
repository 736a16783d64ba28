import re

from hypothesis import given, settings
from hypothesis import strategies as st
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import parsing
from tessera.plans.preparation import ORACLE
from tests.conftest import DATA, rows

GOOD = "S1,L1,2010,7,9,16.58,State,County,P48,?,OBS1,?,1,38,"


def judged(lines):
    blocks, reasons, _ = parsing.parse_lines(pa.array(lines, pa.string()))
    assert sum(len(b) for b in blocks) == len(reasons) == len(lines)
    return reasons


def test_reasons():
    cases = {
        GOOD: None,
        GOOD + '"he said ""late"", left"': None,
        ",".join(f'"{f}"' for f in GOOD.split(",")): None,
        GOOD + '"open, never closed': "unclosed_quote",
        GOOD + ' "late"': "stray_quote",
        GOOD + ",more": "too_many_fields",
        "S1,L1": "too_few_fields",
        "": "empty_line",
        GOOD.replace("P48", "P4B"): "bad_count_type",
        GOOD.replace("P48", "Р48"): "bad_count_type",
        GOOD.replace(",38,", ",10+,"): "bad_agelaius_phoeniceus",
        GOOD.replace(",38,", ",٣,"): "bad_agelaius_phoeniceus",
        GOOD.replace("State", '"a"b'): "text_after_quote",
        GOOD + '"the "late start" one"': "text_after_quote",
        GOOD + '"the ""late"" start': "unclosed_quote",
        GOOD + '"the ""late"" start"': None,
    }
    assert dict(zip(cases, judged(list(cases)), strict=True)) == cases
    for line, reason in cases.items():  # alone, so that no neighbour decides
        assert judged([line]) == [reason]


def test_line_breaks_and_marks_inside_lines_are_not_mistaken_for_records():
    lines = [GOOD + '"a\nb"', GOOD + '"a', GOOD, GOOD + "\r", "﻿" + GOOD, GOOD + "x" * 100_000, None]
    assert judged(lines) == [None, "unclosed_quote", None, None, None, None, "null_line"]


def test_a_byte_order_mark_stays_wherever_the_line_stands():
    lines = ["\ufeff" + GOOD] + [GOOD] * 40 + ["\ufeff" + GOOD]
    blocks, _, _ = parsing.parse_lines(pa.array(lines))
    assert [v for v in pa.concat_tables(blocks)["SAMPLING_EVENT_ID0"].to_pylist() if v != "S1"] == ["\ufeffS1"] * 2


def test_bisection_finds_each_bad_record_in_a_large_block():
    lines = [GOOD] * 5000
    for k in (0, 7, 2500, 4999):
        lines[k] = "bad"
    _, reasons, strict = parsing.parse_lines(pa.array(lines))
    assert [k for k, r in enumerate(reasons) if r] == [0, 7, 2500, 4999]
    assert strict == 4


@pytest.mark.parametrize("with_fields", [False, True])
def test_only_isolated_lines_are_read_strictly(with_fields):
    """At sf0.1 6 % of the lines are bad: the columnar reader takes all others."""
    lines = pq.read_table(f"{DATA}/sf0.1/raw_checklists.parquet")["raw_line"].combine_chunks()
    blocks, reasons, strict = parsing.parse_lines(lines.chunk(0) if isinstance(lines, pa.ChunkedArray) else lines, with_fields=with_fields)
    assert sum(map(len, blocks)) == len(reasons) == len(lines) and 0 < sum(r is not None for r in reasons) <= strict < 0.07 * len(lines)


FIELD = st.sampled_from(["a", "", '"', '""', '"x"', '"x,y"', '"x""y"', 'x"', '"x"y', '"a"b"', "P20", '"P20"', "?", "7", '"7"', "X", " "])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=13, max_size=17).map(",".join), min_size=1, max_size=40), st.integers(1, 9))
def test_blocks_agree_with_the_lines_cut_at_their_quotes(lines, block):
    lines = [re.sub("^(([^,]*,){8})a", r"\1P20", x) for x in lines] + [GOOD, GOOD + '"a,""b"', None]
    blocks, reasons, _ = parsing.parse_lines(pa.array(lines, pa.string()), block=block)
    con = duckdb.connect()
    con.register("raw_checklists", pa.table({"line_id": range(len(lines)), "raw_line": pa.array(lines, pa.string())}))
    assert dict(con.execute(ORACLE["p1_rejects"]).fetchall()) == {k: r for k, r in enumerate(reasons) if r}
    remarks = dict(con.execute(f"SELECT line_id, remarks FROM ({ORACLE['p1_records']})").fetchall())
    assert remarks == {k: v for k, (v, r) in enumerate(zip(pa.concat_tables(blocks)["REMARKS"].to_pylist(), reasons, strict=True)) if r is None}


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, GOOD, "z"), (1, GOOD, "z"), (2, None, "z"), (None, "x", None)], "line_id long, raw_line string, year string")
    out = parsing.parse_records(df)
    assert rows(out, "line_id", "is_valid", "reject_reason", "year") == [(1, True, None, 2010), (1, True, None, 2010), (2, False, "null_line", None), (None, False, "too_few_fields", None)]
    assert parsing.valid_records(out).count() == 2
    assert parsing.parse_records(df.limit(0)).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
