import pytest
from pyspark.sql import functions as F

from ebbtide.functions import columns as col
from ebbtide.functions.labels import column_label, lower_first, screen_label


def values(spark, inputs, fn):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, s string")
    return [r[0] for r in d.orderBy("i").select(fn(F.col("s"))).collect()]


def test_dates_in_many_shapes(spark):
    got = values(spark, ["2025-01", "2025-01-31", "2025-01-31 10:00", "2025/1/5", "31/01/2025", "01/31/2025", "01/2025", "31-01-2025", "31/01/25",
                         "2025-02-30", "texto", " ", None], lambda c: col.to_month(c).cast("string"))
    assert got == ["2025-01-01"] * 9 + [None] * 4


def test_text_numbers(spark):
    got = values(spark, ["1.234,5", "1,234.5", "3,5", "3.5", "1.234", "-2,5", "abc", "", None], col.text_to_number)
    assert got == [1234.5, 1234.5, 3.5, 3.5, 1234.0, -2.5, None, None, None]
    assert values(spark, ["1.234,5", "12", "1,2,3", "abc"], col.looks_numeric) == [True, True, False, False]


def test_category_spelling(spark):
    assert values(spark, [" Cancelado ", "1.0", "1,0", "True", "falso", "Sim", "2.5", None], col.norm_value) == ["cancelado", "1", "1", "1", "0", "sim", "2.5", ""]


def test_ids(spark):
    d = spark.createDataFrame([(7.0,), (7.5,), (None,)], "x double")
    assert [r[0] for r in d.select(col.norm_id(F.col("x"), numeric=True)).collect()] == ["7", "7.5", None]
    assert values(spark, [" C007 ", ""], col.norm_id) == ["C007", None]


def test_display(spark):
    d = spark.createDataFrame([(1234.5,), (3.0,), (-0.04,), (-12.34,), (None,)], "x double")
    assert [r[0] for r in d.select(col.number_text(F.col("x"))).collect()] == ["1.234", "3", "0,0", "−12,3", "—"]
    assert [r[0] for r in d.select(col.percent_text(F.col("x") / 100)).collect()][1] == "3%"


def test_payment_order(spark):
    assert values(spark, ["Nota a prazo", "PIX", "Cartao de debito", "debito", "cheque", None], col.payment_group) == [
        "a_prazo", "pix", "credito", "debito", "cheque", "outros"]


def test_search_text(spark):
    assert values(spark, ["Ação-Nº 10%", "  ÉÈ__x "], col.search_text) == ["acao n 10%", "ee x"]


@pytest.mark.parametrize("x,step", [(3.0, 2.5), (1.4, 1.0), (0.07, 0.05), (80.0, 100.0), (2.1, 2.0)])
def test_round_step(spark, x, step):
    assert spark.range(1).select(col.round_step(F.lit(x))).first()[0] == pytest.approx(step)


def test_labels():
    assert column_label("uso_plataforma_pct") == "Uso plataforma pct"
    assert screen_label("uso_pct") == "Uso (%)"
    assert screen_label("tempo_medio_h") == "Tempo médio (h)"
    assert lower_first("NPS médio") == "NPS médio" and lower_first("Uso") == "uso"


def test_relative_quarter(spark):
    d = spark.createDataFrame([(i,) for i in (-1, -3, -4, -6, -7)], "r int")
    assert [r[0] for r in d.select(col.relative_quarter(F.col("r"))).collect()] == [-1, -1, -2, -2, -3]
