"""Frequency of every distinct value, term or n-gram, in occurrences and records.

The values of whole records are spread over blocks by record and concatenated. A
block is a true suffix array: suffixes are ranked by prefix doubling and sorted, and
the lengths of the common prefixes of neighbours delimit, for any n, the intervals
of one n-gram. An interval's width is its occurrences; its records are the width
less the adjacent duplicates of a record inside it. No other record shares a
block's records, so the blocks' counts only have to be added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens in one suffix array; blocks end where the record changes.
BLOCK_TOKENS = 300_000
#: Rows of a record beyond which it is cut over several blocks, whose counts are merged by record first.
SPLIT_ROWS = 50_000


def suffix_array(code: np.ndarray, rest: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes, equal ones by record, and the length of the prefix each shares with the one before.

    ``code`` holds the tokens of all values one after the other, ``rest`` how many
    tokens a suffix has to the end of its value (0: no suffix begins here).
    """
    n, longest = len(code), int(rest.max(initial=0))
    levels = [np.unique(code, return_inverse=True)[1].astype(np.int64)]
    reach, at = 1, np.arange(n)
    while reach < longest:
        rank = levels[-1]
        following = np.where(rest > reach, rank[np.minimum(at + reach, n - 1)], -1)
        finer = np.unique(rank * (n + 2) + following + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(finer)
        reach *= 2
        if finer.max() == rank.max() and len(levels) > 2:
            break
    order = np.lexsort((record, levels[-1]))
    order = order[rest[order] > 0]
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    same = levels[-1][a] == levels[-1][b]
    whole = np.minimum(rest[a], rest[b])
    shared = np.where(same, whole, 0)
    for level in range(len(levels) - 2, -1, -1):
        x, y = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
        more = (shared < whole) & (levels[level][x] == levels[level][y])
        shared = np.where(more, np.minimum(shared + (1 << level), whole), shared)
    common[1:] = shared
    return order, common


def interval_counts(order: np.ndarray, common: np.ndarray, rest: np.ndarray, record: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of an example, occurrences, records) of every n-gram: the intervals in which neighbours share ``n`` tokens.

    ``record`` is -1 where unknown, which counts as no record.
    """
    long_enough = rest[order] >= n
    begins = (common < n)[long_enough]
    members = order[long_enough]
    interval = np.cumsum(begins) - 1
    first = members[begins]
    width = np.bincount(interval, minlength=len(first))
    known = record[members] >= 0
    of, own = interval[known], record[members][known]
    by_record = np.lexsort((own, of))
    of, own = of[by_record], own[by_record]
    duplicate = (of[1:] == of[:-1]) & (own[1:] == own[:-1])
    records = np.bincount(of, minlength=len(first)) - np.bincount(of[1:][duplicate], minlength=len(first))
    return first, width, records


_OUT = pa.schema([("field_name", pa.string()), ("gram", pa.list_(pa.string())), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64()), ("part_of", pa.string())])
_OUT_SQL = "field_name string, gram array<string>, n int, occurrences long, records long, part_of string"


def _block(table: pa.Table, fields: list[str], lengths: list[int] | None) -> pa.RecordBatch:
    """Counts of one block; ``part_of`` names the record if the block is a part of one."""
    table = table.combine_chunks()
    one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    row_record = one(table["record"].combine_chunks()).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens, rest, record, field = [], [], [], []
    for k, name in enumerate(fields):
        lists = one(table[name].combine_chunks())
        size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        end = np.repeat(np.cumsum(size), size)
        gone = flat.is_null().to_numpy(zero_copy_only=False)
        stop = np.where(gone, np.arange(len(flat)), len(flat))
        stop = np.minimum.accumulate(stop[::-1])[::-1]  # no n-gram runs over a missing token
        tokens.append(flat)
        rest.append(np.minimum(end, stop) - np.arange(len(flat)))
        record.append(np.repeat(row_record, size))
        field.append(np.full(len(flat), k))
    flat, rest, record, field = pa.concat_arrays(tokens), *(np.concatenate(x).astype(np.int64) for x in (rest, record, field))
    if not len(flat):
        return pa.RecordBatch.from_pylist([], schema=_OUT)
    coded = flat.dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 + field * (len(coded.dictionary) + 1)
    order, common = suffix_array(code, rest, record)
    counts = [(n, *interval_counts(order, common, rest, record, n)) for n in lengths or range(1, int(rest.max()) + 1)]
    first = np.concatenate([c[1] for c in counts])
    n = np.concatenate([np.full(len(c[1]), c[0]) for c in counts]).astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    values = flat.take(pa.array(np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])))
    part = table["record"][0].as_py() if table["split"][0].as_py() else None
    columns = [pa.array(fields).take(pa.array(field[first])), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(n), *(pa.array(np.concatenate([c[k] for c in counts]), pa.int64()) for k in (2, 3)), pa.array([part] * len(n), pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def _worker(fields: list[str], lengths: list[int] | None, block_tokens: int):
    def weight(table: pa.Table) -> np.ndarray:
        return sum(pa.compute.fill_null(pa.compute.list_value_length(table[f]), 0).to_numpy().astype(np.int64) for f in fields) + 1

    def run(batches):
        kept, held = [], 0
        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            held += int(weight(kept[-1]).sum())
            if held < block_tokens:
                continue
            rest = pa.concat_tables(kept)
            while True:
                # The rows come sorted by key; the last key may go on in the next batch. A part of a record stands alone.
                key = rest["key"].to_numpy()
                ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                if not len(ends) or held < block_tokens:
                    break
                full = np.cumsum(weight(rest))[ends - 1]
                cut = int(ends[min(np.searchsorted(full, block_tokens), len(ends) - 1)])
                yield from _blocks(rest.slice(0, cut), fields, lengths)
                rest = rest.slice(cut)
                held = int(weight(rest).sum())
            kept = [rest]
        if held:
            yield from _blocks(pa.concat_tables(kept), fields, lengths)

    return run


def _blocks(table: pa.Table, fields: list[str], lengths: list[int] | None):
    whole = table.filter(pa.compute.invert(table["split"]))
    if len(whole):
        yield _block(whole, fields, lengths)
    parts = table.filter(table["split"])
    for record in pa.compute.unique(parts["record"]).to_pylist() if len(parts) else []:
        yield _block(parts.filter(pa.compute.equal(parts["record"], record)), fields, lengths)


def record_sizes(rows: DataFrame, record: Column) -> tuple[DataFrame, int, int]:
    """(record, rows) of the known records, how many there are, and the rows of the largest."""
    per = rows.groupBy(record.cast("string").alias("record")).agg(F.count("*").alias("rows")).filter("record is not null")
    known, most = per.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    return per, known, most


def ngram_frequencies(rows: DataFrame, *, record: Column, values: dict[str, Column], lengths: list[int] | None = None, sizes: tuple[DataFrame, int, int] | None = None, block_tokens: int = BLOCK_TOKENS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Counts of all n-grams of each field's token arrays: field_name, gram (array), n, occurrences, records.

    ``lengths`` asks for some n only; without it n-grams of every length are
    returned, whose number grows with the square of a value's tokens. Null tokens
    are no terms (an n-gram does not run over one), null values count nothing, a
    null record counts in ``occurrences`` only. Repeated rows count each. An empty
    table gives an empty result.
    """
    per, _, most = sizes or record_sizes(rows, record)
    names = list(values)
    slim = rows.select(record.cast("string").alias("record"), *(v.cast("array<string>").alias(f"v{k}") for k, v in enumerate(values.values())))
    number = F.monotonically_increasing_id()
    slim = slim.withColumn("at", number)
    if most > split_rows:
        # A record with so many rows is cut into parts, at most one row of ``large`` for each ``split_rows`` rows of the table.
        large = per.filter(F.col("rows") > split_rows).select(F.col("record").alias("large"), F.ceil(F.col("rows") / split_rows).alias("parts"))
        slim = slim.join(large, F.col("record") == F.col("large"), "left").withColumn("split", F.col("parts").isNotNull())
        key = F.xxhash64("record", F.pmod("at", F.col("parts")))
    else:
        slim, key = slim.withColumn("split", F.lit(False)), F.xxhash64("record")
    # A row without a record has no other to meet.
    key = F.when(F.col("record").isNull(), F.xxhash64(F.floor(F.col("at") / 1000))).when(F.col("split"), key).otherwise(F.xxhash64("record"))
    fields = [f"v{k}" for k in range(len(names))]
    spread = slim.select(key.alias("key"), "record", "split", *fields).repartition("key").sortWithinPartitions("key")
    partial = spread.mapInArrow(_worker(fields, lengths, block_tokens), _OUT_SQL)
    if most > split_rows:
        parts = partial.filter("part_of is not null").groupBy("field_name", "gram", "n", "part_of").agg(F.sum("occurrences").alias("occurrences"), F.lit(1).cast("long").alias("records"))
        partial = partial.filter("part_of is null").drop("part_of").unionByName(parts.drop("part_of"))
    counts = partial.groupBy("field_name", "gram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    name = F.element_at(F.array(*(F.lit(x) for x in names)), F.substring("field_name", 2, 10).cast("int") + 1)
    return counts.withColumn("field_name", name)


def marked_terms(rows: DataFrame, *, record_col: str, fields: list[str], least_records: int = 3, most_share: float = 0.05, **how) -> DataFrame:
    """Every distinct value of ``fields``, stripped and upper-cased: field_name, term, occurrences, records, mark.

    ``mark`` is ``too_rare`` in fewer than ``least_records`` records, ``too_common``
    in more than ``most_share`` of all distinct records of the table, else ``useful``.
    Null, empty and ``?`` are no values. A value is one token of the suffix array.
    """
    sizes = record_sizes(rows, F.col(record_col))
    value = lambda c: F.upper(F.trim(F.col(c).cast("string"), F.lit(" \t\r\n")))
    values = {c: F.when((value(c) != "") & (value(c) != "?"), F.array(value(c))) for c in fields}
    counts = ngram_frequencies(rows, record=F.col(record_col), values=values, lengths=[1], sizes=sizes, **how)
    # Shares as whole millionths: a value at exactly the limit stays useful in any arithmetic.
    common = F.col("records") * 1_000_000 > F.lit(round(most_share * 1_000_000) * sizes[1])
    mark = F.when(F.col("records") < least_records, "too_rare").when(common, "too_common").otherwise("useful")
    return counts.select("field_name", F.element_at("gram", 1).alias("term"), "occurrences", "records", mark.alias("mark"))


def word_ngrams(rows: DataFrame, *, record_col: str, fields: list[str], **how) -> DataFrame:
    """All word n-grams, of every length, of the values of ``fields``: field_name, gram (words joined by a blank), n, occurrences, records."""
    words = lambda c: F.filter(F.split(F.upper(F.col(c).cast("string")), r"[ \t\r\n]+"), lambda w: w != "")
    counts = ngram_frequencies(rows, record=F.col(record_col), values={c: words(c) for c in fields}, **how)
    return counts.select("field_name", F.array_join("gram", " ").alias("gram"), "n", "occurrences", "records")
