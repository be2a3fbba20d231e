import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import aggregate as agg
from tallyframe.operators import charts, ledger, references
from tallyframe.operators.aggregate import Measure
from tallyframe.operators.charts import Shape


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1001])
def test_order_statistics_equal_sorted_values(spark, n):
    rng = random.Random(n)
    xs = [rng.choice([1.0, 2.0, rng.random() * 1e6]) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = agg.numeric_summary(df, "x").first()
    s = sorted(xs)
    if not n:
        assert got.n == 0 and got.q1 is None and got.median is None
        return
    want = (n, s[0], s[n // 4], statistics.median(s), s[-1 if n < 4 else 3 * n // 4], s[-1])
    assert (got.n, got["min"], got.q1, got.median, got.q3, got["max"]) == want
    assert agg.scalar(df, Measure("median", "x")).first().value == statistics.median(s)


M, C, T = "numeric_measure", "categorical", "time_like"


@pytest.mark.parametrize(
    ("shape", "chart"),
    [
        (Shape(1, {"a": M}), None),
        (Shape(5, {"parameter": "text", "value": M}), "table"),
        (Shape(5, {"a": C, "unit": "unit_label", "v": M}), "table"),
        (Shape(5, {"a": C, "v": M}, missing=0.3), "table"),
        (Shape(5, {"a": "text", "v": M}, unparsed_times=True), "table"),
        (Shape(9, {"x": M, "y": M, "z": M}, grid=("x", "y")), "heatmap"),
        (Shape(5, {"a": C, "mass (kg)": M, "time (s)": M}), "table"),
        (Shape(5, {"mass (kg)": M, "time (s)": M}), "scatter"),
        (Shape(5, {"a": C, "v": M, "v error": M}), "error_bar"),
        (Shape(5, {"a": C, "x": M, "y": M}, content="correlation matrix"), "heatmap"),
        (Shape(5, {"a": C, "x": M, "y": M}, composition=True), "stacked_bar"),
        (Shape(5, {"a": C, "x": M, "y": M}, composition=True, negative=True), "bar"),
        (Shape(8, {"a": C, "v": M}, repeated_groups=2), "boxplot"),
        (Shape(9, {"x": M, "y": M}, content="replicates"), "boxplot"),
        (Shape(4, {"a": C, "p": "composition_value"}, distinct={"a": 4}), "pie"),
        (Shape(4, {"t": T, "v": M}), "line"),
        (Shape(6, {"a": C, "b": C, "v": M}, crossed=(("a",), "b"), repeated_groups=2), "bar"),
        (Shape(4, {"a": C, "v": M}), "bar"),
        (Shape(20, {"v": M}), "histogram"),
        (Shape(5, {"v": M}), "table"),
        (Shape(50, {"a": "text"}), None),
    ],
)
def test_chart_rules_in_their_order(shape, chart):
    assert charts.choose(shape)[0] == chart


def test_axes_of_scatter_and_units():
    s = Shape(5, {"mass": M, "trial 1": M, "trial 2": M, "mean": M}, distinct={"mass": 1})
    assert charts.choose(s)[2] == ("trial 1", "mean")
    assert charts.comparison_pair(["measured tau", "theoretical tau"]) == ("theoretical tau", "measured tau")
    assert [charts.unit_signature(h) for h in ("mass (kg)", "share", "rate %", "Revenue (2026)", "name", "cost(元)")] == ["kg", "%", "%", "", "name"[:0], "元"]
    assert charts.warnings_of(Shape(5, {"id": "id_like", "a": "text"}, missing=0.5, negative=True)) == ["many cells are missing", "identifiers are no measures", "no numeric measure", "negative values rule out whole-part charts"]


def test_names_of_authors(spark):
    texts = ["Atanassova, I., Bertin, M., & Mayr, P.", "Iana Atanassova, Marc Bertin and Philipp Mayr", "Atanassova, Bertin et al. (2020, May)", "Atanassova I, Bertin M", "International Energy Agency", "National Institute of Standards and Technology, Okafor, M."]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(references.surnames(F.col("t")).alias("n")).collect()]
    assert [n[:2] for n in got[:4]] == [["Atanassova", "Bertin"]] * 4
    assert got[0][2] == got[1][2] == "Mayr" and got[4] == [] and got[5] == ["Okafor"]
    rows = [(["atanasova", "okafor"], ["i. atanassova"]), (["van der berg"], ["jan van der berg"]), (["smyth"], ["smith"]), (["王小明"], ["王小明"]), (["王"], ["李"])]
    lost = spark.createDataFrame(rows, "a array<string>, b array<string>").select(references.unmatched(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in lost] == [["okafor"], [], ["smyth"], [], ["王"]]


def test_title_tokens_in_order_though_one_is_absent():
    assert references.align("x a b d e", "a b c d e") == (0.8, 2)
    assert references.align("", "a b")[0] == 0.0
    assert references.align("Li (2020). On pre training of models. Press", "Pretraining of models") == (1.0, 14)
    assert references.align("Énergie: knowledgebase maps", "Retracted: Énergie knowledge base maps") == (1.0, 0)
    scattered = "deep " + "x " * 9 + "learning " + "y " * 9 + "maps"
    assert references.align(scattered, "deep learning maps")[0] < 0.5
    assert references.align("王小明（2020）。板式熱交換器的研究。", "板式熱交換器的研究")[0] == 1.0


def test_references_in_any_script_meet_their_works(spark):
    works = spark.createDataFrame([(1, None, "板式熱交換器的研究", ["王小明"], 2020, False), (2, None, "On art", ["Li Wu"], 2019, False)], "work_id long, doi string, title string, authors array<string>, year int, retracted boolean")
    refs = spark.createDataFrame([(1, "王小明（2020）。板式熱交換器的研究。學報"), (2, "Wu, L. (2019). On art. Press"), (3, "Nobody (2001). Sea of ice")], "ref_id long, text string")
    got = {r.ref_id: (r.work_id, r.verdict) for r in references.match_references(refs, works).collect()}
    assert got[1][0] == 1 and got[2][0] == 2 and got[3] == (None, "not_found")


def test_ledger_ids_number_repeats(spark):
    rows = [("s", "csv", "csv_row", 1, "same"), ("s", "csv", "csv_row", 2, "same"), ("s", "csv", "csv_row", 3, "other"), ("t", "csv", "csv_row", 1, "same"), ("s", "csv", "csv_row", 4, None)]
    got = ledger.build_ledger(spark.createDataFrame(rows, "source_id string, file_type string, block_type string, line_start long, content string")).collect()
    assert sorted((r.source_id, r.line_start, r.occurrence) for r in got) == [("s", 1, 1), ("s", 2, 2), ("s", 3, 1), ("s", 4, 1), ("t", 1, 1)]
    assert len({r.evidence_id for r in got}) == 5


def test_columns_beyond_the_fortieth_are_named(spark):
    from tallyframe.operators.profile import column_profile

    wide = spark.createDataFrame([tuple(range(42))], ", ".join(f"c{i} int" for i in range(42)))
    assert {r.column for r in column_profile(wide).collect() if r.role == "skipped"} == {"c40", "c41"}
