from tabsense.operators.charts import chart_line, line_extremes


def test_line_extremes_against_all_rows(spark):
    rows = [("a" if k % 3 else None, float(k % 50), float((k * 37) % 101)) for k in range(600)]
    rows += [("a", None, 1.0), ("a", float("nan"), 5000.0), ("a", 3.0, None), ("a", float("inf"), 2.0), ("b", 49.0, -7.0)]
    df = spark.createDataFrame(rows, "c string, x double, y double").repartition(5)
    got = {tuple(r) for r in chart_line(df, "x", "y", "c", intervals=7).collect()}
    groups = {}
    for c, x, y in rows:
        if x is not None and y is not None and 0 <= x < 1000:
            groups.setdefault((c, min(6, int(x / 49.0 * 7.0))), []).append((x, y))
    want = set()
    for (c, i), points in groups.items():
        swapped = [(y, x) for x, y in points]
        for x, y in (min(points), max(points), min(swapped)[::-1], max(swapped)[::-1]):
            want.add((c, i, x, y))
    assert got == want


def test_line_extremes_small_tables(spark):
    df = spark.createDataFrame([(4, 1.0), (4, 9.0), (4, 5.0)], "x int, y double")
    assert sorted(map(tuple, line_extremes(df, "x", "y", intervals=10).collect())) == [(0, 4, 1.0), (0, 4, 9.0)]
    assert line_extremes(df.where("false"), "x", "y").count() == 0
    assert [f.name for f in line_extremes(df.where("false"), "x", "y").schema] == ["interval", "x", "y"]
