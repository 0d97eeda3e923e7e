"""Brute-force counterparts used by the tests."""

import re

READ_SCHEMA = (
    "query_name string, flag int, reference_name string, reference_start bigint, mapping_quality int, "
    "cigar string, query_sequence string, query_length int, source_file string, read_ordinal bigint"
)


def read(ordinal, cigar, sequence, start=100, contig="chr1", mapq=60, flag=0, file="f"):
    return (f"r{ordinal}", flag, contig, start, mapq, cigar, sequence, len(sequence or ""), file, ordinal)


def query_bases(cigar):
    return sum(int(n) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", cigar) if c in "MIS=X")


def walk_pairs(cigar, start):
    """(query position, reference position) of every aligned base."""
    pairs, q, r = [], 0, start
    for n, code in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if code in "M=X":
                pairs.append((q, r))
            q += code in "MIS=X"
            r += code in "MDN=X"
    return pairs


def walk_windows(cigar, start, size, step):
    pairs = walk_pairs(cigar, start)
    spans = (pairs[i : i + size] for i in range(0, len(pairs) - size + 1, step))
    return [
        (s[0][1], s[-1][1] + 1, s[0][0], s[-1][0] + 1) for s in spans if s[-1][1] - s[0][1] == size - 1
    ]


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, result):
    """The rows and column types of a query and of an executed DuckDB statement are the same."""
    order = [c[0] for c in result.description]
    columns = sorted((c[0], str(c[1])) for c in result.description)
    expected = sorted(repr(tuple(row[order.index(c)] for c, _ in columns)) for row in result.fetchall())
    assert sorted((f.name, TYPES[f.dataType.simpleString()]) for f in df.schema) == columns
    assert sorted(repr(tuple(row[c] for c, _ in columns)) for row in df.collect()) == expected
