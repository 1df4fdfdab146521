"""Schemas and the delimited-text dialect."""

import random

import pytest
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.sources.ingest import convert, read_csv, read_csv_with_header
from tessera.sources.schema import TYPES, parse_header, parse_schema


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_schema_files():
    schema = parse_schema("# a table\n\nid,INT64,\nname,STRING\r\nday,DATE\nat,TIMESTAMP\nflag,CHAR\nbig,INT128\n")
    assert schema.fieldNames() == ["id", "name", "day", "at", "flag", "big"]
    assert schema["id"].dataType == T.LongType() and not schema["id"].nullable and schema["big"].dataType == T.DecimalType(38, 0)
    for bad in ("id,INT65", "id", "id,INT32,x", ",INT32", ""):
        with pytest.raises(EngineError):
            parse_schema(bad)
    assert [f.dataType for f in parse_header([f"{k}:c{i}" for i, k in enumerate(TYPES)]).fields] == list(TYPES.values())
    with pytest.raises(EngineError):
        parse_header(["id"])


def test_header_and_last_lines(spark, tmp_path):
    for text in ("INT32:h1,INT32:h2\n1,2", "INT32:h1,INT32:h2\n1,2\n"):
        assert rows(read_csv_with_header(spark, write(tmp_path, text))) == [(1, 2)]
    assert rows(read_csv_with_header(spark, write(tmp_path, "STRING:a,STRING:b\n,\n"))) == [("", "")]
    assert rows(read_csv_with_header(spark, write(tmp_path, "STRING:h1\nx\n"))) == [("x",)]
    with pytest.raises(EngineError):
        read_csv_with_header(spark, write(tmp_path, ""))


def test_dialect(spark, tmp_path):
    schema = parse_schema("a,STRING\nb,STRING")
    text = '"x,y", "say ""hi"""\n"two\nlines",  padded  \n"tail  ",д\n'
    assert sorted(rows(read_csv(spark, write(tmp_path, text), schema))) == [("tail", "д"), ("two\nlines", "padded"), ("x,y", 'say "hi"')]
    assert rows(read_csv(spark, write(tmp_path, "p;q\n"), schema, sep=";")) == [("p", "q")]
    assert rows(read_csv(spark, write(tmp_path, " p \tq\n"), schema, sep="\t")) == [("p", "q")]
    with pytest.raises(EngineError):
        read_csv(spark, write(tmp_path, "p\n"), schema, sep='"')


def tokens(text, sep=","):
    """Rows of values, one character after the other."""
    out, row, value, quoted, started, at = [], [], "", False, False, 0
    while at < len(text):
        c = text[at]
        at += 1
        if not started and c in " \t\r":
            continue
        started = True
        if quoted:
            if c == '"' and text[at : at + 1] == '"':
                value, at = value + '"', at + 1
            elif c == '"':
                quoted = False
            elif c != "\r":
                value += c
        elif c == '"':
            quoted = True
        elif c in (sep, "\n"):
            row, value, started = [*row, value.rstrip(" \t")], "", False
            if c == "\n":
                out, row = [*out, row], []
        elif c != "\r":
            value += c
    if started or row:
        value = value[:-1] if quoted and text[-1] == "\n" else value  # an open quote closes before the last line feed
        out.append([*row, value.rstrip(" \t")])
    return out


def test_values_match_a_tokenizer_that_reads_one_character_after_the_other(spark, tmp_path):
    assert tokens('ab"c,d"e,z\n"x\t",\'\n') == [["abc,de", "z"], ["x", "'"]]
    draw = random.Random(5)
    bits = ["a", "b c", ",", ",", '"', '"', '""', "\n", " ", "\t", "\r", "д", "x" * 50]
    for multi_line in (None, True):
        for k in range(15):
            text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 60))) + draw.choice(["", "\n"])
            want = tokens(text)
            width = max(map(len, want), default=1)
            want = [r for r in want if len(r) == width]
            lines = [",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') or v != v.strip() else v for v in r) for r in want]
            schema = parse_schema("\n".join(f"c{i},STRING" for i in range(width)))
            if len(tokens(text)) == len(want):  # as it is
                got = rows(read_csv(spark, write(tmp_path, text, f"{k}.csv"), schema, multi_line=multi_line))
                assert sorted(got) == sorted(map(tuple, want)), text
            if lines:
                got = rows(read_csv(spark, write(tmp_path, "\n".join(lines) + "\n", f"{k}w.csv"), schema, multi_line=multi_line))
                assert sorted(got) == sorted(map(tuple, want)), lines


def test_files_are_split_and_rows_that_span_blocks_are_joined(spark, tmp_path):
    schema = parse_schema("i,INT32\ns,STRING")
    want = [(i, f"line {i}\nand, more" * (i % 3)) for i in range(400)]
    text = "INT32:i,STRING:s\n" + "".join(f'{i},"{s}"\n' for i, s in want)
    plain = "INT32:i,STRING:s\n" + "".join(f"{i},s{i}\n" for i in range(2000))
    path, flat = write(tmp_path, text, "many.csv"), write(tmp_path, plain, "flat.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = read_csv_with_header(spark, path)
        assert sorted(rows(got)) == want
        split = read_csv_with_header(spark, flat)
        assert split.rdd.getNumPartitions() > 3 and "Window" not in split._jdf.queryExecution().toString()
        assert sorted(rows(split)) == [(i, f"s{i}") for i in range(2000)]
        with pytest.raises(Exception, match="a quote is not closed"):
            read_csv(spark, path, schema, header=True, multi_line=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = "y" * 200_000
    assert rows(read_csv(spark, write(tmp_path, f'1,"{long}""{long}"\n', "long.csv"), schema)) == [(1, f'{long}"{long}')]


@pytest.mark.parametrize("inner", ["and, more", "neither", "1,2,3"])
def test_every_task_names_an_open_quote(spark, tmp_path, inner):
    """Which of them fails first is left to chance."""
    schema = parse_schema("i,INT32\ns,STRING")
    path = write(tmp_path, '1,"a\n' + f"{inner}\n" * 500 + 'b"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = read_csv(spark, path, schema, multi_line=False).rdd
        assert got.getNumPartitions() > 3
        for k in range(got.getNumPartitions()):
            with pytest.raises(Exception, match="a quote is not closed"):
                spark.sparkContext.runJob(got, list, [k])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for multi_line in (None, True):
        with pytest.raises(Exception, match="i: no INT32: x") as raised:
            read_csv(spark, write(tmp_path, "x,y\n", "x.csv"), schema, multi_line=multi_line).collect()
        assert "quote" not in str(raised.value).splitlines()[0]


@pytest.mark.parametrize(("schema", "text"), [
    ("a,INT16\nb,INT16", "1\n"),
    ("a,INT16\nb,INT16", "1,99999\n"),
    ("a,INT16\nb,INT16", "1,\n"),
    ("a,INT32\nb,DATE", "1,2013-7-1\n"),
    ("a,INT32\nb,TIMESTAMP", "1,2013-07-01\n"),
    ("a,INT32\nb,CHAR", "1,xy\n"),
    ("a,INT32\nb,CHAR", "1,\n"),
    ("a,INT32\nb,DATE", "1,2013-02-30\n"),
    ("a,INT32\nb,INT128", "1,1.5\n"),
    ("a,INT32\nb,INT32", "1,2,3\n"),
])
def test_bad_values_raise(spark, tmp_path, schema, text):
    with pytest.raises(Exception):
        read_csv(spark, write(tmp_path, text), parse_schema(schema)).collect()


def test_convert(spark, tmp_path):
    source = write(tmp_path, "1,Ж,2013-07-01,2013-07-01 10:20:30,1.5,c\n")
    schema = write(tmp_path, "id,INT16\nname,STRING\nday,DATE\nat,TIMESTAMP\nscore,FLOAT\nflag,CHAR\n", "s.schema")
    convert(spark, source, str(tmp_path / "out"), schema)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.dtypes == [("id", "smallint"), ("name", "string"), ("day", "date"), ("at", "timestamp_ntz"), ("score", "float"), ("flag", "string")]
    assert str(rows(back)[0][3]) == "2013-07-01 10:20:30" and rows(back)[0][1] == "Ж"
    convert(spark, write(tmp_path, "INT32:id,STRING:name,FLOAT:score\n1,a,2.5\n2,b,3\n"), str(tmp_path / "out2"))
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out2")))) == [(1, "a", 2.5), (2, "b", 3.0)]
