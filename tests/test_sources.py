from decimal import Decimal

import pytest

from assayer.errors import AssayError
from assayer.session import scratch_path
from assayer.sources import csv, screens
from assayer.sources.catalog import Catalog


@pytest.fixture
def file(tmp_path):
    def write(content, name="t.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)
    return write


def code_of(action):
    with pytest.raises(AssayError) as caught:
        action()
    return caught.value.code


def test_types_and_missing_words(spark, file):
    df = csv.ingest_csv(spark, file(
        "id,name,x,flag,none,half\n1,a,1.5,True,,1\n2,NA,inf,FALSE,NaN,z\n3,\"q,\"\"z\"\"\",-2,,,3\n"))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"),
                         ("flag", "boolean"), ("none", "double"), ("half", "string")]
    got = df.collect()
    assert got[1]["name"] is None and got[1]["x"] == float("inf") and got[1]["flag"] is False
    assert got[2]["name"] == 'q,"z"' and got[2]["flag"] is None


def test_short_rows_are_filled_and_long_rows_rejected(spark, file):
    assert csv.ingest_csv(spark, file("a,b,c\n1,2\n3,4,5\n")).collect()[0]["c"] is None
    assert code_of(lambda: csv.ingest_csv(spark, file("a,b\n1,2\n3,4,5\n"))) == "malformed_csv"
    assert code_of(lambda: csv.ingest_csv(
        spark, file('a,b\n1,2\n3,4,,"x,y"\n'))) == "malformed_csv"


def test_header_only_and_empty(spark, file):
    df = csv.ingest_csv(spark, file("a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0
    assert code_of(lambda: csv.ingest_csv(spark, file(""))) == "empty_file"
    assert code_of(lambda: csv.ingest_csv(spark, "/nowhere/x.csv")) == "dataset_not_found"


def test_encodings_and_quoted_lines(spark, file):
    assert csv.ingest_csv(spark, file("n\ncaf\xe9\n".encode("latin-1"))).first()["n"] == "café"
    assert csv.ingest_csv(spark, file(b"\xef\xbb\xbfn\n\xc3\xa9\n")).columns == ["n"]
    df = csv.ingest_csv(spark, file('a,b\n1,"x\ny"\n2,z\n'))
    assert [r["b"] for r in df.orderBy("a").collect()] == ["x\ny", "z"]


def test_folders(spark, file, tmp_path):
    file("n,v\nJos\u00e9,1\n", "a.csv")
    file("n,v\nJos\u00e9,2\n".encode("latin-1"), "b c.csv")
    file('n,v\n"two\nlines",3\n', "d.csv")
    groups = csv.detect_layouts(spark, str(tmp_path))
    assert sorted((g.encoding, g.multi_line) for g in groups) == [
        ("ISO-8859-1", False), ("UTF-8", False), ("UTF-8", True)]
    got = {r["v"]: r["n"] for r in csv.ingest_csv(spark, str(tmp_path)).collect()}
    assert got == {1: "Jos\u00e9", 2: "Jos\u00e9", 3: "two\nlines"}
    file("v,n\n4,x\n", "e.csv")
    assert code_of(lambda: csv.ingest_csv(spark, str(tmp_path))) == "malformed_csv"


def test_repeated_and_blank_names(spark, file):
    assert csv.ingest_csv(spark, file("a,a,,a.1\n1,2,3,4\n")).columns == [
        "a", "a.1", "Unnamed: 2", "a.1.1"]


def test_large_whole_numbers(spark, file):
    df = csv.ingest_csv(spark, file(
        "u,big\n18446744073709551615,99999999999999999999999999\n1,2\n"))
    assert df.dtypes == [("u", "decimal(20,0)"), ("big", "string")]
    assert df.first()["u"] == Decimal("18446744073709551615")


def test_file_screens(spark, file, tmp_path):
    file("a\n1\n", "good.csv")
    file("a\n1\n", "Good2.CSV")
    file("", "empty.csv")
    file("x" * 300, "large.csv")
    file("x", "note.txt")
    file(bytes(range(256)), "odd.csv")
    got = {r["name"]: r["verdict"] for r in screens.file_screen(
        screens.list_files(spark, str(tmp_path)), max_bytes=290).collect()}
    assert got == {"good.csv": None, "Good2.CSV": None, "empty.csv": "empty_file",
                   "large.csv": "file_too_large", "note.txt": "unsupported_file_type",
                   "odd.csv": None}
    odd = {r["path"].split("/")[-1] for r in screens.binary_screen(
        spark, str(tmp_path)).where("verdict IS NOT NULL").collect()}
    assert odd == {"odd.csv"}
    limited = {r["path"].split("/")[-1]: r["verdict"] for r in screens.binary_screen(
        spark, str(tmp_path), "*.csv", max_bytes=290).collect()}
    assert limited["large.csv"] == "file_too_large" and limited["odd.csv"] == \
        "unsupported_content"
    blank = spark.createDataFrame([("p", "  ", 3)], "path string, name string, length bigint")
    assert screens.file_screen(blank).first()["verdict"] == "missing_filename"


def test_listing_of_nested_folders(spark, tmp_path):
    names = ["a.csv", "b c.csv", "50%.csv", "sub/é#?.csv", "sub/deep/x+y.csv", "sub/note.txt",
             "sub/_hidden.csv", ".dot.csv", "two/three/four/z.csv"]
    for k, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * k)
    (tmp_path / "bare").mkdir()
    listed = {r["path"].removeprefix(f"file://{tmp_path}/"): r["length"]
              for r in screens.list_files(spark, str(tmp_path)).collect()}
    assert listed == {n: k for k, n in enumerate(names) if "_hidden" not in n and ".dot" not in n}
    only = screens.list_files(spark, f"file://{tmp_path}", "*.txt").collect()
    assert [r["name"] for r in only] == ["note.txt"]
    one = screens.list_files(spark, str(tmp_path / "b c.csv")).first()
    assert (one["name"], one["length"]) == ("b c.csv", 1)
    with pytest.raises(AssayError, match="unreadable_folder"):
        screens.list_files(spark, str(tmp_path / "none"))


def test_unprintable_share(spark):
    df = spark.createDataFrame([("é" * 3 + "a" * 7,), ("é" * 4 + "a" * 6,), ("",), ("a\0",)],
                               "t string")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(screens.looks_binary(F.col("t"))).collect()] == [
        False, True, False, True]


def test_catalog(spark):
    store = Catalog(spark, scratch_path(spark, "catalog"))
    assert store.list().count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "n int, s string")
    store.register(df, "two.csv", "b-2", size_bytes=12)
    store.register(df.limit(0), "one.csv", "a_1")
    listed = store.list().collect()
    assert [r["id"] for r in listed] == ["a_1", "b-2"] and "columns" not in store.list().columns
    row = store.get("b-2").first()
    assert (row["row_count"], row["missing_value_count"], row["duplicate_row_count"]) == (3, 1, 1)
    assert [tuple(c) for c in row["columns"]] == [("n", "int"), ("s", "string")]
    assert store.load("b-2").schema == df.schema and store.load("b-2").count() == 3
    assert code_of(lambda: store.load("none")) == "dataset_not_found"
    assert code_of(lambda: store.load("../b-2")) == "dataset_not_found"
