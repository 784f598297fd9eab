import csv
import io
import random

import pytest

from assayer.sources import csv as S, records as K


def rows_of(text, separator=","):
    """Rows by Python's reader, without the header and empty lines."""
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if r][1:]


def some_text(seed, rows=300):
    pick = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=pick.choice(["\n", "\r\n"]))
    writer.writerow(["id", "a", "b"])
    for i in range(rows):
        cells = ["".join(pick.choices(["x", "yy", " ", '"', "\n", ",", "é", "\n\n", '""'],
                                      k=pick.randrange(0, 9))) + "z" for _ in range(2)]
        if pick.random() < 0.02:
            cells[0] = "long\n" * 200 + "z"
        writer.writerow([i, *cells])
        if pick.random() < 0.1:
            out.write("\n")
    return out.getvalue()


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('a,"b', True, False), ('"a","b"', False, False),
    ('a"b,c', False, False), ('5" pipe,"x', True, True), ('"a""b",c', False, False),
    ('"a""', True, False), ('"a"b"c,d', False, False), ('"', True, False), ('""', False, True),
    ('x","y', True, True), ('x","y"', False, False), ('"a",', False, False), (',"', True, False),
])
def test_state_after_a_line(line, outside, inside):
    assert K.inside_after(line, False) is outside
    assert K.inside_after(line, True) is inside


def test_records_over_many_blocks(spark, tmp_path, small_blocks):
    for seed in (1, 2):
        text = some_text(seed)
        path = tmp_path / f"t{seed}.csv"
        path.write_bytes(text.encode())
        df = S.read_text(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        got = sorted((r["id"], r["a"], r["b"]) for r in df.collect())
        assert got == sorted(map(tuple, rows_of(text)))
        assert all(r[S.CORRUPT] is None for r in df.collect())


def test_stray_quotes_and_folders(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('id,a\n1,5" pipe\n' + '2,"x\ny"\n' * 60)
    (tmp_path / "b.csv").write_text("id,a\n" + "3,plain\n" * 40 + '4,"open\nto the end')
    got = [(r["id"], r["a"]) for r in S.read_text(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([("1", '5" pipe')] + [("2", "x\ny")] * 60 + [("3", "plain")] * 40
                                 + [("4", "open\nto the end")])


def test_too_many_fields_are_found(spark, tmp_path, small_blocks):
    (tmp_path / "m.csv").write_text('id,a\n1,"x\ny"\n2,b,c\n')
    text = S.read_text(spark, str(tmp_path / "m.csv"))
    assert [(r["line"], r["field_count"]) for r in S.malformed_rows(text).collect()] == [
        ("2,b,c", 3)]
