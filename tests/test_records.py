"""Records over several lines: equal to plain readers wherever the files are cut."""

import csv
import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from cadastrum.plans import income, sales
from cadastrum.sources import readers, records


@pytest.fixture
def cut_at(spark):
    """Sets the length of the byte ranges in which files are read."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {name: spark.conf.get(name) for name in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield cut
    for name, value in old.items():
        spark.conf.set(name, value)


HARD = [
    'a;b',
    '"x\ny";2',
    '"say ""so""\n\n;;";3',
    'plain;4',
    'an 8" pipe;5',
    '"";6',
    '"""";"\n"',
    '"end""\n";"a;\r\nb"',
    '"both\n1";"both\n2"',
    'a;b',
]


def plain(text, sep=";"):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return [tuple(r) for r in rows[1:]]


def test_equal_to_a_plain_reader_at_every_cut(spark, tmp_path, cut_at):
    text = "\n".join(HARD) + "\n"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_bytes(text.encode())
    expected = sorted(plain(text))
    for size in [2, 3, 5, 8, 11, 29, len(text) - 1, 10_000]:
        cut_at(size)
        found = readers.read_delimited(spark, str(tmp_path / "x"), sep=";", multi_line=True)
        assert found.columns == ["a", "b"]
        assert sorted(tuple(r) for r in found.collect()) == expected, size


def test_random_files(spark, tmp_path, cut_at):
    chance = random.Random(6)
    expected = []
    for number in range(6):
        buffer = io.StringIO(newline="")
        writer = csv.writer(buffer, delimiter="|", lineterminator="\r\n" if number % 2 else "\n", quoting=csv.QUOTE_ALL if number == 3 else csv.QUOTE_MINIMAL)
        writer.writerow(["n", "text"])
        for i in range(120):
            row = (str(i), "".join(chance.choices('ab"|\n ;', k=chance.randrange(1, 9))))
            writer.writerow(row)
            expected.append(row)
        (tmp_path / f"{number}.csv").write_bytes(("﻿" if number == 2 else "").encode() + buffer.getvalue().encode())
    for size in (300, 100_000):
        cut_at(size)
        found = readers.read_delimited(spark, str(tmp_path), sep="|", multi_line=True)
        assert sorted(tuple(r) for r in found.collect()) == sorted(expected), size


def lines_and_reader():
    """The action of a line from either state against a reader of single characters."""

    def after(line, inside):
        state = "inside" if inside else "start"
        i = 0
        while i < len(line):
            c = line[i]
            if state == "start":
                state = "inside" if c == '"' else "start" if c == ";" else "plain"
            elif state == "plain":
                state = "start" if c == ";" else "plain"
            elif c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state = "plain"
            i += 1
        return int(state == "inside")

    chance = random.Random(2)
    lines = ["".join(chance.choices('";a', k=n)) for n in range(11) for _ in range(150)]
    return lines, after


def test_actions_of_lines(spark):
    lines, after = lines_and_reader()
    grammar = records.delimited_grammar(";")
    rows = spark.createDataFrame([(line,) for line in lines], "value string").select("value", grammar.step.alias("s"), grammar.fresh.alias("f"))
    for line, step, fresh in rows.collect():
        assert [(step if fresh else start + step) % 2 for start in (0, 1)] == [after(line, 0), after(line, 1)], line


def test_only_states_of_ranges_are_ordered(spark, tmp_path):
    """Ranges without open fields are read without a shuffle of their lines."""
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    plan = records.records_of(records.lines_of(spark, str(tmp_path)), records.delimited_grammar(";"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


DOCUMENT = {
    "year": 2024, "available_years": [2023, 2024], "generated_at": "now {[", "source_file": 'a"b}', "total_sales_count": 3,
    "median_price_m2": 10.5, "median_surface": 70.0, "sales_count_by_department": {"01": 1, "2A": 2},
    "median_price_m2_by_department": {"01": 10.0}, "median_price_m2_by_property_type": {"Maison": 4.0},
}


def camel_keys(document):
    names = {"median_price_m2": "medianPricePerSquareMeter", "median_price_m2_by_department": "medianPricePerSquareMeterByDepartment",
             "median_price_m2_by_property_type": "medianPricePerSquareMeterByPropertyType"}
    return {names.get(k, readers.camel(k)): v for k, v in document.items()}


@pytest.mark.parametrize("size", [60, 100_000])
def test_documents_in_any_layout(spark, tmp_path, cut_at, size):
    layouts = {
        "line": json.dumps(DOCUMENT), "indented": json.dumps(DOCUMENT, indent=2), "bom": "﻿" + json.dumps(DOCUMENT, indent=4),
        "camel": json.dumps(camel_keys(DOCUMENT), indent="\t"), "crlf": json.dumps(DOCUMENT, indent=1).replace("\n", "\r\n"),
        "many": "\n".join([json.dumps(DOCUMENT), json.dumps(DOCUMENT, indent=2), "", json.dumps(DOCUMENT)]),
        "cut": json.dumps(DOCUMENT, indent=2)[:-20], "cut between": json.dumps(DOCUMENT)[:-30] + "\n" + json.dumps(DOCUMENT, indent=2), "no json": "hello",
    }
    for name, text in layouts.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    cut_at(size)
    rows = sales.read_summaries(spark, str(tmp_path)).collect()
    good = [r for r in rows if r.readable]
    assert len(good) == 9 and len({tuple(str(v) for v in r) for r in good}) == 1
    assert (good[0].year, good[0].total_sales_count, good[0].sales_count_by_department) == (2024, 3, {"01": 1, "2A": 2})
    assert good[0].median_price_m2_by_property_type == {"Maison": 4.0} and good[0].source_file == 'a"b}'
    broken = [r for r in rows if not r.readable]
    assert len(broken) == 3 and all(v is None for r in broken for k, v in r.asDict().items() if k != "readable")


def test_income_documents_indented_and_broken(spark, tmp_path):
    one = {"source": "s", "latest_year": 2018, "communes_covered": 4, "national_median_income": 20.5}
    whole = {"latest_year": 2018, "summaries_by_year": {"2018": one, "x": one}}
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=3))
    (tmp_path / "b.json").write_text(json.dumps(whole, indent=3)[:60])
    rows = sorted(income.read_summaries(spark, str(tmp_path)).collect(), key=lambda r: r.readable)
    assert [(r.readable, r.year, r.communes_covered) for r in rows] == [(False, None, None), (True, 2018, 4)]


def test_quoted_delimiters_are_no_delimiters(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(['name|"a, b, c"|3'] * 20) + "\n")
    assert readers.detect_delimiter(spark, str(tmp_path)) == "|"
    (tmp_path / "a.txt").write_text('"x;y";"z\n' + "\n".join(['1;"2,3";"4""5, 6"'] * 20))
    assert readers.detect_delimiter(spark, str(tmp_path)) == ";"


def test_gzip_by_content(spark, tmp_path):
    """Names may lie; several members and a member's end on a chunk's end are fine."""
    body = "\n".join(f'{i};"a\n{i}"' for i in range(3000))
    parts = {
        "plain.csv": ("n;v\n" + body).encode(), "named.gz": gzip.compress(("n;v\n" + body).encode()),
        "plain-named.gz": ("﻿n;v\r\n" + body + "\n").encode(), "hidden.txt": gzip.compress(b"n;v\n1;x\n2") + gzip.compress(b";y\n") + gzip.compress(b""),
        "empty.csv": b"", "empty.gz": gzip.compress(b""),
    }
    for name, content in parts.items():
        (tmp_path / name).write_bytes(content)
    assert {(r.path.rsplit("/")[-1], r.gzip) for r in readers.misnamed_files(spark, str(tmp_path)).collect()} == {("plain-named.gz", False), ("hidden.txt", True)}
    found = readers.read_sniffed(spark, str(tmp_path))
    assert found.columns == ["n", "v"]
    expected = [(str(i), f"a\n{i}") for i in range(3000)] * 3 + [("1", "x"), ("2", "y")]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_lines_and_texts_are_not_shuffled(spark, tmp_path):
    """Neither to assemble records over several lines nor to find the headers."""
    (tmp_path / "a.csv").write_text('a;b\n"x\ny";2\n"x\nz";3\n')
    lines = records.lines_of(spark, str(tmp_path))
    found = records.records_of(lines, records.delimited_grammar(";"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    states = records.range_states(lines.withColumns({"step": F.lit(1), "fresh": F.lit(False)}), records.delimited_grammar(";"))
    # The one shuffle holds a row per range.
    assert states._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    read = readers.read_delimited(spark, str(tmp_path), sep=";", multi_line=True)
    assert sorted(tuple(r) for r in read.collect()) == [("x\ny", "2"), ("x\nz", "3")]
    assert "SortMergeJoin" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in read._jdf.queryExecution().optimizedPlan().toString()


def test_lines_out_of_order_are_brought_together(spark):
    """Rows of a range that lie in several tasks, as in a stored table."""
    lines = [("f", 0, i, text) for i, text in enumerate(['a;"b', 'c"', "", 'd;e', '"', '";1'])] + [("g", 0, 0, '"x'), ("g", 5, 1, 'y"')]
    rows = spark.createDataFrame(lines[::-1], "file string, range long, row long, value string").repartition(5)
    found = records.records_of(rows, records.delimited_grammar(";"), placed=False)
    assert sorted((r.file, r.text, r.complete) for r in found.collect()) == sorted(
        [("f", 'a;"b\nc"', True), ("f", "", True), ("f", "d;e", True), ("f", '"\n";1', True), ("g", '"x\ny"', True)]
    )
