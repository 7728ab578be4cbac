import os
import tempfile

from tabsense.sources import io as sio


def test_csv_latin1_fallback(spark):
    d = tempfile.mkdtemp(prefix="tabsense-csv-")
    path = os.path.join(d, "x.csv")
    with open(path, "wb") as fh:
        fh.write("name,value\ncafé,1\nnaïve,2\n".encode("latin-1"))
    df = sio.scan_csv(spark, path)
    assert sorted(r["name"] for r in df.collect()) == ["café", "naïve"]
    assert dict(df.dtypes)["value"] == "int"


def test_json_array_and_lines(spark):
    d = tempfile.mkdtemp(prefix="tabsense-json-")
    arr = os.path.join(d, "a.json")
    with open(arr, "w") as fh:
        fh.write('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert sio.scan_json(spark, arr).count() == 2
    lines = os.path.join(d, "l.json")
    with open(lines, "w") as fh:
        fh.write('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert sio.scan_json(spark, lines, multi_line=False).count() == 3
    assert sio.scan_json(spark, lines).count() == 3  # detected as JSON lines


def test_load_table_normalizes(spark):
    d = tempfile.mkdtemp(prefix="tabsense-load-")
    path = os.path.join(d, "x.csv")
    with open(path, "w") as fh:
        fh.write("Sales ($),Region Name\n1.5,N\nInf,S\nNaN,E\n")
    df = sio.load_table(spark, path, "csv")
    assert df.columns == ["Sales", "Region_Name"]
    assert sorted(r["Sales"] is None for r in df.collect()) == [False, True, True]


def test_scan_batch_per_file_quality(spark):
    import pytest
    from tabsense.operators.profile import quality_score
    d = tempfile.mkdtemp(prefix="tabsense-batch-")
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    with open(a, "w") as fh:
        fh.write("x,y\n1,u\n2,v\n2,v\n,w\n")
    with open(b, "w") as fh:
        fh.write("x,y\n5,p\n6,q\n")
    rows, per_file = sio.scan_batch(spark, [a, b], "csv")
    got = {os.path.basename(r["source_file"]): (r["rows"], r["quality_score"]) for r in per_file.collect()}
    assert got["a.csv"][0] == 4 and got["b.csv"][0] == 2
    single = quality_score(sio.scan_csv(spark, a)).first()["quality_score"]
    assert got["a.csv"][1] == pytest.approx(single)
    summary = sio.batch_summary(per_file).first()
    assert summary["files"] == 2 and summary["total_rows"] == 6
    assert rows.count() == 6
