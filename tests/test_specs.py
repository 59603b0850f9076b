import pytest

from quadrat.functions.text import inherent_form, kept_form, normal_id, strip_status
from quadrat.sources import specs

from .conftest import rows


def write(tmp_path, text):
    path = tmp_path / "spec.csv"
    path.write_text(text)
    return str(path)


def test_filter_spec_keeps_blanks_and_ignores_extra_columns(spark, tmp_path):
    path = write(tmp_path, "note,ba_id,gf_id\nx,a1,\ny,a2,g1\nz,a1,\n")
    assert rows(specs.load_filter(spark, path), "attribute_id", "form_id") == [("a1", ""), ("a2", "g1")]


def test_missing_column_blank_cell_and_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="the column gf_id is missing"):
        specs.load_filter(spark, write(tmp_path, "ba_id\na\n"))
    with pytest.raises(ValueError, match="ba_id is blank in row 2"):
        specs.load_filter(spark, write(tmp_path, "ba_id,gf_id\na,\n,g\n,h\n"))
    assert specs.load_filter(spark, write(tmp_path, "")).count() == 0
    assert specs.load_filter(spark, write(tmp_path, "ba_id,gf_id\n")).count() == 0


def test_first_present_candidate_name(spark, tmp_path):
    columns = [specs.SpecColumn(("gf", "growth_form"))]
    assert rows(specs.load_spec(spark, write(tmp_path, "growth_form,id\nx,1\n"), columns), "gf") == [("x",)]
    with pytest.raises(ValueError, match="of the columns gf, growth_form not one is there"):
        specs.load_spec(spark, write(tmp_path, "id\n1\n"), columns)


def test_rollup_last_row_wins(spark, tmp_path):
    path = write(
        tmp_path, "from_ba_id,from_gf_id,to_ba_id,to_gf_id\na,,b,\na,,c,g\nd,x,b,\n"
    )
    got = rows(specs.load_rollup(spark, path), *[c.output for c in specs.ROLLUP_COLUMNS])
    assert got == [("a", "", "c", "g"), ("d", "x", "b", "")]


def test_source_lists(spark, tmp_path):
    path = write(tmp_path, "name,Source ID\nx,12.0\ny, 7 \nz,\nw,12\nv,nan\nu,abc\n")
    listed = specs.load_source_ids(spark, path).orderBy(specs.LINE)
    assert [r["source_id"] for r in listed.collect()] == ["12", "7", "abc"]
    assert specs.id_column(["source_id", "id"]) == "id"
    assert specs.id_column(["q", "id"], "q") == "q"
    with pytest.raises(ValueError):
        specs.id_column(["q"], "z")
    with pytest.raises(ValueError):
        specs.id_column(["q"])


def test_item_lists(spark, tmp_path):
    path = write(tmp_path, "s,t\na,1\n,2\nb,3\n")
    assert rows(specs.load_items(spark, path), "item") == [("a",), ("b",)]
    assert rows(specs.load_items(spark, path, "t"), "item") == [("1",), ("2",), ("3",)]
    with pytest.raises(ValueError):
        specs.load_items(spark, path, "missing")


def test_text_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [("a.JPG - Confirmed",), (" b.JPG",), ("c - d -  Unconfirmed ",), ("x - Other",)], "n string"
    )
    assert rows(df.select(strip_status(F.col("n")))) == [("a.JPG",), ("b.JPG",), ("c - d",), ("x - Other",)]
    ids = spark.createDataFrame([("1.0",), ("x1",), ("NaN",), ("  ",), ("1e3",), ("12d",), ("7f",), ("12345678901234567",)], "i string")
    assert [r[0] for r in ids.select(normal_id(F.col("i"))).collect()] == ["1", "x1", None, None, "1000", "12d", "7f", "12345678901234567"]
    forms = spark.createDataFrame([("MASSIVE",), (" branching",), ("foliose",), (None,), ("a, b",)], "f string")
    got = [tuple(r) for r in forms.select(kept_form(F.col("f")), inherent_form(F.col("f"))).collect()]
    assert got == [("Massive", "Massive"), ("Branching", "Branching"), ("", ""), ("", None), ("", None)]
