"""Array files read by byte ranges beside ``json``, whole and broken."""

import json
import random
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airloom.session import scratch_path
from airloom.sources import landed, ranges

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def small_ranges(spark):
    before = [spark.conf.get(c) for c in SIZES]
    spark.conf.set(SIZES[1], 1)
    yield lambda n: spark.conf.set(SIZES[0], n)
    for c, v in zip(SIZES, before):
        spark.conf.set(c, v)


def land(spark, texts):
    folder = Path(scratch_path(spark, "arrays").removeprefix("file:"))
    folder.mkdir(parents=True)
    for i, text in enumerate(texts):
        (folder / f"location_{i}.json").write_text(text, encoding="utf-8")
    return str(folder)


def read(spark, path):
    found = {}
    for r in ranges.array_records(spark, path).collect():
        found.setdefault(int(r.source_file.split("_")[-1][:-5]), []).append((r.position, r.text))
    return {f: [t for _, t in sorted(rows)] for f, rows in found.items()}


def record(i):
    words = ["plain", "br{ace", 'q"uote', "back\\slash", "}{][", 'a\\"b{', "esc\\\\", "nl\nx", "é漢😀"]
    return {"value": i, "t": "".join(random.choices(words, k=3)), "s": [{"id": 1}, {"x": ["{", {"y": []}]}], "p": {"a": {"b": i}}, "e": [[]]}


@pytest.mark.parametrize("size", [500, 10**7])
def test_records_of_any_layout_and_range(spark, small_ranges, size):
    random.seed(size)
    small_ranges(size)
    rows = [record(i) for i in range(60)]
    path = land(spark, [json.dumps(rows), json.dumps(rows, indent=2), json.dumps(rows, separators=(",", ":"), ensure_ascii=False), json.dumps(rows, indent=0), "[]", " [ ] ", json.dumps(rows[:1])])
    found = read(spark, path)
    for f in range(4):
        assert [json.loads(t) for t in found[f]] == rows
    assert set(found) == {0, 1, 2, 3, 6} and json.loads(found[6][0]) == rows[0]


VALUES = st.recursive(
    st.none() | st.integers(-9, 9) | st.text(st.sampled_from('a{}[]",\\\n: é'), max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", "{", '"']), inner, max_size=3), max_leaves=6,
)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["k", "}", "\\"]), VALUES, max_size=3), min_size=1, max_size=8), st.sampled_from([None, 1, 3]), st.integers(16, 90))
def test_random_arrays(spark, small_ranges, rows, indent, size):
    small_ranges(size)
    assert [json.loads(t) for t in read(spark, land(spark, [json.dumps(rows, indent=indent)]))[0]] == rows


DAMAGE = [
    ('"b": 7', '"b": x7'),  # no value
    ('"value": 7,', '"value": "7,'),  # a text that does not end
    ('"b": 7\n      }\n    }', '"b": 7\n      }'),  # a missing brace
    ('"value": 7,', '"value": 7, "more": {"c": 1,'),  # one brace too many
    ('"b": 7', '"b": [7'),
    ('"b": 7\n', '"b": 7}\n'),
]


def test_a_broken_record_costs_itself_where_the_array_is_indented(spark, small_ranges):
    random.seed(1)
    small_ranges(700)
    rows = [record(i) for i in range(12)]
    text = json.dumps(rows, indent=2)
    path = land(spark, [text.replace(*d) for d in DAMAGE])
    parsed = ranges.parse_records(ranges.array_records(spark, path)).withColumn("good", F.col("record").isNotNull()).drop("record").collect()
    for f in range(len(DAMAGE)):
        own = [r for r in parsed if r.source_file.endswith(f"_{f}.json")]
        assert [json.loads(r.text) for r in sorted(own, key=lambda r: r.position) if r.good] == rows[:7] + rows[8:], DAMAGE[f]
        assert sum(not r.good for r in own) == 1


def test_elements_that_are_no_objects_are_rows_of_their_own(spark):
    path = land(spark, ['[{"a": 1}, "text", 5, {"a": 2}, null]'])
    found = ranges.parse_records(ranges.array_records(spark, path)).selectExpr("position", "to_json(record) AS r").collect()
    assert sorted((r.position, r.r) for r in found) == [(0, '"text"'), (0, "5"), (0, '{"a":1}'), (1, "null"), (1, '{"a":2}')]


def test_files_that_are_no_arrays(spark):
    path = land(spark, ['{"results": [{"a": 1}]}', "not json", '[{"a": 1}]', "[1, 2]"])
    assert set(read(spark, path)) == {2}
    broken = {r.source_file.split("_")[-1]: r.reject_reason for r in ranges.broken_arrays(spark, path).collect()}
    assert broken == {"0.json": landed.NOT_ARRAY, "1.json": landed.NOT_ARRAY, "3.json": landed.NOT_ARRAY}


def test_records_are_those_of_the_whole_file_reader(spark, small_ranges):
    from airloom.catalog.landing import FLAT, land_arrays

    small_ranges(20_000)
    path = land_arrays(spark, "/root/testdata/sf0.001")
    whole = landed.explode_records(landed.parse_documents(landed.read_documents(spark, path)))
    cut = ranges.parse_records(ranges.array_records(spark, path)).drop("text")
    a, b = (landed.accepted(landed.typed_records(r)).select("source_file", "position", *FLAT) for r in (whole, cut))
    b = b.withColumn("position", b["position"].cast("int"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def small_chunks(spark):
    before = spark.conf.get(BATCH)
    yield lambda n: spark.conf.set(BATCH, n)
    spark.conf.set(BATCH, before)


@pytest.mark.parametrize("chunk, size", [(1, 10**7), (4, 10**7), (3, 900)])
def test_records_do_not_depend_on_chunks(spark, small_ranges, small_chunks, chunk, size):
    random.seed(2)
    rows = [record(i) for i in range(12)]
    text = json.dumps(rows, indent=2)
    texts = [json.dumps(rows), text, *[text.replace(*d) for d in DAMAGE], '[{"a": "{"}, {"b\\": [{]', '[{"a": 1, "b": "x, {}, {"}, 7, {}]\u2028']
    path = land(spark, texts)
    one = read(spark, path)
    small_ranges(size)
    small_chunks(chunk)
    assert read(spark, path) == one
    assert [json.loads(t) for t in one[0]] == rows and [json.loads(t) for t in one[1]] == rows


def test_tables_between_hold_chunks_and_not_every_brace(spark, monkeypatch):
    staged = {}

    def counted(df, name):
        table = stage(df, name)
        staged[f"{name} {len(staged)}"] = table.count()
        return table

    stage = ranges.stage
    monkeypatch.setattr(ranges, "stage", counted)
    path = land(spark, [json.dumps([{"value": i, "p": {"a": {"b": i}}} for i in range(2000)])])
    assert ranges.array_records(spark, path).count() == 2000
    assert staged and max(staged.values()) <= 20  # 6,001 before
