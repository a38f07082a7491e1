"""The import file: all columns, further images, missing values, CSV with quotes and lines."""
import csv

from tagloom.operators import import_file as I


def test_rows_and_csv(spark, tmp_path):
    rows = spark.createDataFrame(
        [('A "b"\nC', "One.\n\n\n\n Two, three ", ["x", "y"], ["u1", "u2"]), ("D!", "", None, None), (None, None, [], [])],
        "title string, description string, tags array<string>, images array<string>")
    made = I.import_file(rows)
    assert made.columns == I.HEADERS and len(I.HEADERS) == 49
    I.write_import_csv(made, str(tmp_path / "out"))
    back = I.read_import_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.collect()))
    by = {(r["Handle"], r["Image Position"]): r for r in back.collect()}
    assert set(by) == {("a-b-c", "1"), ("a-b-c", "2"), ("d", ""), ("product", "")}
    first, second = by["a-b-c", "1"], by["a-b-c", "2"]
    assert first["Body (HTML)"] == "<p>One.</p>\n<p>Two, three</p>" and first["Tags"] == "x, y" and first["SEO Title"] == 'A "b"\nC' and first["Status"] == "active"
    assert {c for c in I.HEADERS if second[c]} == {"Handle", "Image Src", "Image Position", "Image Alt Text"}
    assert by["product", ""]["Variant Inventory Qty"] == "0" and by["d", ""]["Image Alt Text"] == ""
    plain = []  # another reader sees the same
    for file in (tmp_path / "out").glob("*.csv"):
        with open(file, newline="", encoding="utf-8") as lines:
            plain += list(csv.DictReader(lines))
    assert sorted(tuple(r[c] for c in I.HEADERS) for r in plain) == sorted(map(tuple, made.collect()))


def test_a_title_alone_is_enough(spark):
    row = I.import_file(spark.createDataFrame([("Some Pod",)], "title string")).first()
    assert row["Handle"] == "some-pod" and row["Variant Price"] == "" and row["SEO Description"] == ""


def test_no_file_is_longer_than_its_share(spark, tmp_path):
    rows = spark.range(1000).coalesce(1).selectExpr("concat('Item \\n', id) AS title")
    I.write_import_csv(I.import_file(rows), str(tmp_path / "out"), file_rows=300)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 4
    back = I.read_import_csv(spark, str(tmp_path / "out"))
    assert back.select("Title").distinct().count() == back.count() == 1000
    assert 40_000 <= I.FILE_ROWS <= 100_000
