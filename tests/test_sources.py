"""Reading and writing tables."""

import datetime as dt

from haulcast.sources.shipments import shipments
from haulcast.sources.tables import read_table, read_table_with_dates, write_predictions


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_csv_with_bad_values(spark, tmp_path):
    path = write(tmp_path, 'id,cost,day\na,1.5,2024-02-29\nb,oops,2024-02-30\nc,NaN,\n"d,e",,never\n')
    df = read_table_with_dates(spark, path, "id string, cost double, day string", ["day"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        ("a", 1.5, dt.date(2024, 2, 29)), ("b", None, None), ("c", None, None), ("d,e", None, None)]


def test_nan_does_not_enter_from_parquet(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, x double").write.parquet(path)
    assert [r["x"] for r in read_table(spark, path).orderBy("id").collect()] == [None, 3.0]


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1 + 0.2, 1), ("b", 1e-17, 2)], "hospital string, p double, other int")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"out-{fmt}")
        write_predictions(df, path, "hospital", "p", ("id", "cost"), fmt)
        back = (spark.read.parquet(path) if fmt == "parquet"
                else read_table(spark, path, "id string, cost double")).orderBy("id")
        assert back.columns == ["id", "cost"]
        assert [tuple(r) for r in back.collect()] == [("a", 0.1 + 0.2), ("b", 1e-17)]


def test_shipments_read_only_what_they_need(spark):
    df = shipments(spark, "/root/testdata/sf0.001", ["equipment_width", "transport_cost"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "l_shipdate" not in plan and df.count() == 6000
