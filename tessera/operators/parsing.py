"""Rows that fail to parse: block parsing with recursive bisection.

Record blocks go through the columnar CSV reader at once. A block fails as a whole:
by the position of its quotes, by the reader's field count, or by a value outside
of its domain. A failing block is halved until the bad records stand alone; only
those are read by the strict, slow splitter, which names the reason. No record is
lost: each input row gives exactly one output row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The field order of the delivery and the two checked domains.
FIELDS = [
    "SAMPLING_EVENT_ID0", "LOC_ID1", "YEAR", "MONTH", "DAY", "TIME", "STATE_PROVINCE", "COUNTY", "COUNT_TYPE",
    "EFFORT_DISTANCE_KM", "OBSERVER_ID", "GROUP_ID", "PRIMARY_CHECKLIST_FLAG", "Agelaius_phoeniceus", "REMARKS",
]
COUNT_TYPES = ["P20", "P21", "P22", "P23", "P34", "P35", "P48"]
COUNT_DOMAIN = pa.array(COUNT_TYPES)
SIGHTING = r"\A(?:X|\?|[0-9]+)\z"

# A field as bytes of one line: quoted, with inner quotes doubled, or bare. Nothing is tried twice, so a match takes linear time.
_FIELD = rb'(?>"(?>[^"\r\n]++|"")*+"|[^",\r\n]*+)'
#: Text in which every quote opens a field, closes it or stands in it doubled. The columnar reader is laxer (it takes text
#: behind a closing quote, and a quote inside a bare field), so a block as a whole is held against this first.
QUOTING = re.compile(rb"(?>" + _FIELD + rb"[,\n])*+")
_COUNT_TYPE = "|".join([*COUNT_TYPES, *(f'"{c}"' for c in COUNT_TYPES)]).encode()
#: Lines that are all valid, one after the other: what tells the halves of a failing block apart.
RECORDS = re.compile(
    rb"(?>(?!\xef\xbb\xbf)" + (_FIELD + b",") * 8 + b"(?>" + _COUNT_TYPE + b")," + (_FIELD + b",") * 4 + rb'(?>X|\?|[0-9]++|"X"|"\?"|"[0-9]++"),' + _FIELD + rb"\n)*+"
)
TYPED = {"YEAR": "int", "MONTH": "int", "DAY": "int", "TIME": "double", "EFFORT_DISTANCE_KM": "double"}
#: Lines of a block before any halving.
BLOCK = 4096
_MARK = "\ufeff".encode()


def split_strict(line: str) -> tuple[list[str], str | None]:
    """The fields of one line up to the first defect of its quoting, and that defect.

    A field that begins with a quote ends at the next quote that is not doubled,
    which must stand before a comma or the end; no other field may hold a quote.
    """
    fields, at, end = [], 0, len(line)
    while True:
        if at < end and line[at] == '"':
            close = line.find('"', at + 1)
            while 0 <= close < end - 1 and line[close + 1] == '"':
                close = line.find('"', close + 2)
            if close < 0:
                return fields, "unclosed_quote"
            if close + 1 < end and line[close + 1] != ",":
                return fields, "text_after_quote"
            fields.append(line[at + 1 : close].replace('""', '"'))
            at = close + 1
        else:
            close = line.find(",", at)
            close = end if close < 0 else close
            if '"' in line[at:close]:
                return fields, "stray_quote"
            fields.append(line[at:close])
            at = close
        if at == end:
            return fields, None
        at += 1


def diagnose(line: str | None) -> tuple[list[str] | None, str | None]:
    """(fields, None) of a valid line, (None, reason) of any other."""
    if line is None:
        return None, "null_line"
    fields, defect = split_strict(line)
    if defect:
        return None, defect
    if len(fields) != len(FIELDS):
        return None, "empty_line" if not line.strip() else "too_few_fields" if len(fields) < len(FIELDS) else "too_many_fields"
    if fields[8] not in COUNT_TYPES:
        return None, "bad_count_type"
    sighting = fields[13]
    if not (sighting in ("X", "?") or (sighting.isascii() and sighting.isdigit())):
        return None, "bad_agelaius_phoeniceus"
    return fields, None


class _Lines:
    """The lines of one batch, laid out once as one buffer for the columnar reader and the probes."""

    def __init__(self, lines: pa.Array, wanted: list[str]):
        self.lines = lines
        filled = pc.fill_null(lines, "")
        self.data = "\n".join(filled.to_pylist()).encode("utf-8", "surrogatepass") + b"\n"
        self.start = np.concatenate(([0], np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64) + 1))).tolist()
        self.parse = csv.ParseOptions(ignore_empty_lines=False)
        self.convert = csv.ConvertOptions(column_types={f: pa.string() for f in FIELDS}, strings_can_be_null=False, include_columns=wanted)

    def text(self, first: int, stop: int) -> bytes:
        return self.data[self.start[first] : self.start[stop]]

    def read(self, data: bytes, count: int) -> pa.Table | None:
        """``count`` lines as columns if every record among them is valid, else None."""
        # The quoting, and bytes that the reader takes for something else than part of a field.
        if data.startswith(_MARK) or b"\r" in data or data.count(b"\n") != count or (b'"' in data and not QUOTING.fullmatch(data)):
            return None
        options = csv.ReadOptions(column_names=FIELDS, use_threads=False, block_size=len(data) + 1)
        try:
            table = csv.read_csv(pa.BufferReader(data), read_options=options, parse_options=self.parse, convert_options=self.convert)
        except pa.ArrowInvalid:
            return None
        if table.num_rows != count:
            return None
        good = pc.and_(pc.is_in(table["COUNT_TYPE"], COUNT_DOMAIN), pc.match_substring_regex(table["Agelaius_phoeniceus"], SIGHTING))
        return table if pc.all(good, min_count=0).as_py() else None

    def isolated(self, first: int, stop: int) -> list[int]:
        """The bad lines of a failing block, by halving it until they stand alone."""
        bad, todo = [], [(first, stop)]
        while todo:
            low, high = todo.pop()
            a, b = self.start[low], self.start[high]
            if self.data.count(b"\n", a, b) == high - low and RECORDS.fullmatch(self.data, a, b):
                continue
            if high - low == 1:
                bad.append(low)
                continue
            middle = (low + high) // 2
            todo += [(middle, high), (low, middle)]
        return bad


def parse_lines(lines: pa.Array, *, with_fields: bool = True, block: int = BLOCK) -> tuple[list[pa.Table], list[str | None], int]:
    """Parsed blocks in the order of the lines (null fields where rejected), a reason or None for each line, and how many lines were read strictly."""
    wanted = FIELDS if with_fields else ["COUNT_TYPE", "Agelaius_phoeniceus"]
    batch = _Lines(lines, wanted)
    blocks: list[pa.Table] = []
    reasons: list[str | None] = [None] * len(lines)
    strict = 0
    for first in range(0, len(lines), block):
        stop = min(len(lines), first + block)
        table = batch.read(batch.text(first, stop), stop - first)
        if table is None:
            bad = batch.isolated(first, stop)
            edges = [first - 1, *bad, stop]
            rest = b"".join(batch.text(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b > a + 1)
            good = batch.read(rest, stop - first - len(bad)) if rest else None
            if rest and good is None:  # probe and reader disagree: the strict splitter decides
                bad = list(range(first, stop))
            strict += len(bad)
            own = []
            for at in bad:
                fields, reasons[at] = diagnose(lines[at].as_py())
                own.append(dict(zip(FIELDS, fields or [None] * len(FIELDS), strict=True)))
            parts = [pa.table([pa.array([o[f] for o in own], pa.string()) for f in wanted], names=wanted)]
            place = np.full(stop - first, -1)
            place[np.array(bad, np.int64) - first] = np.arange(len(bad))
            place[place < 0] = np.arange(len(bad), stop - first)
            table = pa.concat_tables([*parts, *([good] if good is not None else [])]).take(pa.array(place))
        blocks.append(table)
    return blocks, reasons, strict


def _worker(with_fields: bool, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            blocks, reasons, _ = parse_lines(batch.column(1).cast(pa.string()), with_fields=with_fields)
            columns = [batch.column(0), pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())]
            if with_fields:
                table = pa.concat_tables(blocks).combine_chunks() if blocks else pa.table({f: pa.array([], pa.string()) for f in FIELDS})
                columns += [c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in table.columns]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def parse_records(raw: DataFrame, *, id_col: str = "line_id", line_col: str = "raw_line", with_fields: bool = True) -> DataFrame:
    """Parse delivered lines; one row for each input row: the id, ``is_valid``, ``reject_reason`` and the typed fields.

    Only ``id_col`` and ``line_col`` are read, so further columns cannot clash. A
    null line is rejected as ``null_line``, a blank one as ``empty_line``; lines
    delivered twice are judged one by one; an empty table gives an empty result.
    Fields whose domain is not checked (year, distance, ...) become null where
    they hold no number. The plan has no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("__id", raw.schema[id_col].dataType), T.StructField("is_valid", T.BooleanType()), T.StructField("reject_reason", T.StringType())]
    fields += [T.StructField(f, T.StringType()) for f in FIELDS] if with_fields else []
    schema = T.StructType(fields)
    slim = raw.select(F.col(id_col).alias("__id"), F.col(line_col).cast("string").alias("__line"))
    out = slim.mapInArrow(_worker(with_fields, to_arrow_schema(schema)), schema)
    typed = [F.col(f).try_cast(TYPED[f]).alias(f.lower()) if f in TYPED else F.col(f).alias(f.lower()) for f in FIELDS] if with_fields else []
    return out.select(F.col("__id").alias(id_col), "is_valid", "reject_reason", *typed)


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("is_valid").drop("is_valid", "reject_reason")


def rejected_records(parsed: DataFrame, id_col: str = "line_id") -> DataFrame:
    return parsed.filter("not is_valid").select(id_col, "reject_reason")
