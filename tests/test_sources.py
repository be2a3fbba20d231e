import pytest

from tallyframe.plans import filters
from tallyframe.plans.errors import RequestError
from tallyframe.sources import tabular
from tallyframe.streaming import events


def read(spark, tmp_path, text, **options):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    df = tabular.read_csv(spark, str(path), **options)
    return df.columns, sorted(tuple(r) for r in df.collect())


def test_title_rows_above_the_header_are_skipped(spark, tmp_path):
    got = read(spark, tmp_path, "Quarterly report\n\nname,qty\na,1\nb,2\n")
    assert got == (["name", "qty"], [("a", "1"), ("b", "2")])


def test_a_title_stays_the_header_where_the_next_row_is_not_the_widest(spark, tmp_path):
    columns, rows = read(spark, tmp_path, "title\nname,qty\na,1,extra\n")
    assert columns == ["title"] and ("a",) in rows


def test_rows_that_repeat_the_header_are_data(spark, tmp_path):
    got = read(spark, tmp_path, "name,qty\na,1\nname,qty\nname,qty\n")
    assert got == (["name", "qty"], [("a", "1"), ("name", "qty"), ("name", "qty")])


def test_ragged_quoted_and_blank_rows(spark, tmp_path):
    columns, rows = read(spark, tmp_path, 'a,a,\n1\n"x, y","say ""hi""",3,4\n , ,\n-,-,-\n')
    assert columns == ["a", "a [2]", "column 3"]
    assert rows == sorted([("1", None, None), ("x, y", 'say "hi"', "3"), ("-", "-", "-")], key=str)


def test_other_separators_and_one_column(spark, tmp_path):
    assert read(spark, tmp_path, "a;b\n1;2\n", sep=";") == (["a", "b"], [("1", "2")])
    assert read(spark, tmp_path, "only\n1\n2\n") == (["only"], [("1",), ("2",)])


def test_an_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(RequestError):
        read(spark, tmp_path, "\n")


def test_readers_ledger_and_names(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "c.toml").write_text('a = "x"\n[b]\nc = 1\n')
    assert {r.a for r in tabular.read_source(spark, str(tmp_path / "r.json")).collect()} == {1, 2}
    assert tabular.read_source(spark, str(tmp_path / "c.toml")).first().asDict() == {"a": "x", "b": '{"c": 1}'}
    with pytest.raises(RequestError):
        tabular.read_source(spark, "x.pdf")
    out = str(tmp_path / "ledger")
    tabular.write_ledger(spark.createDataFrame([("e1", 3)], "evidence_id string, n long"), out)
    assert tabular.read_ledger(spark, out, "evidence_id string, n long").collect() == [("e1", 3)]
    with pytest.raises(RequestError):
        tabular.find_frame({"a.csv": None}, "b")


def test_filters_refuse_unknown_columns_and_empty_results(spark):
    df = spark.range(3)
    with pytest.raises(RequestError, match="id"):
        filters.select_rows(df, "nothing=1")
    with pytest.raises(RequestError):
        filters.require_rows(df, "id>5")
    assert filters.require_rows(df, "id>5", allow_empty=True).count() == 0 and filters.columns_of("a>1 & b~x") == ["a", "b"]


def test_windows_run_as_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 1), (1, "2024-01-01 10:00:00", 1), (2, "2024-01-01 12:00:00", 1), (3, "2024-01-03 12:00:00", 2), (4, "2024-01-09 00:00:00", 2)]
    batch = spark.createDataFrame(rows, "event_id long, t string, user_id long").selectExpr("event_id", "timestamp(t) AS ts", "user_id", "'a' AS event_type", "1.0D AS value", "'{}' AS props")
    batch.write.parquet(str(tmp_path / "in"))

    def run(name, made):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    stream = events.read_events(spark, str(tmp_path / "in"))
    closed = run("tumbled", events.tumbling(events.deduplicated(stream)))
    assert sorted(r.n for r in closed.collect()) == [1, 2]  # the last day is still open, the repeat is gone
    assert sorted((r.user_id, r.n) for r in run("sessions", events.sessions(stream)).collect()) == [(1, 3), (2, 1)]
    assert run("slid", events.sliding(stream)).count() > 0
