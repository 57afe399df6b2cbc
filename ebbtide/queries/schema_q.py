"""Queries: reading, cleaning, schema inference, mapping, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import month_label
from ..operators import mapping as mp
from ..operators import schema as sc
from ..operators.stats import shared_folder
from ..sources import readers as rd_
from ..sources import writers as wr
from .base import E_SQL, e_labels, e_panel
from .registry import query, table
from .rounding import rd, rs


def scratch(spark):
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks
@query("source_clean_table", """SELECT c_custkey::DOUBLE AS id, c_acctbal AS balance, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_name AS code_2 FROM customer""")
def clean(spark, sf):
    c = table(spark, sf, "customer")
    raw = c.select(F.col("c_custkey").cast("string").alias(" id "), F.concat(F.lit(" "), F.translate(F.format_number("c_acctbal", 2), ",.", ".,")).alias("balance"),
                   F.when(F.col("c_mktsegment") == "BUILDING", "   ").otherwise(F.col("c_mktsegment")).alias("segment"), F.lit(None).cast("string").alias("empty"),
                   F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), F.concat("c_name", F.lit("  ")).alias("code "))
    return rd_.clean_table(raw)


@query("source_documentation_filter", """SELECT 'customer' AS tab, CAST(NULL AS VARCHAR) AS reason UNION ALL SELECT 'leia-me', 'parece documentação (nome da aba e só texto)'
  UNION ALL SELECT 'textos', 'parece documentação (1–2 colunas de texto longo)' UNION ALL SELECT 'dic', 'parece um dicionário de dados (colunas de campo e descrição)' UNION ALL SELECT 'vazia', 'tabela vazia'""")
def doc_filter(spark, sf):
    d = table(spark, sf, "documents")
    cases = {"customer": table(spark, sf, "customer"), "leia-me": d.select("lang"), "textos": d.select("text"),
             "dic": d.select(F.col("lang").alias("Campo"), F.col("text").alias("Descrição"), "n_chars"), "vazia": d.filter("doc_id < 0")}
    return spark.createDataFrame([(k, rd_.documentation_reason(k, v)) for k, v in cases.items()], "tab string, reason string")


@query("source_delimited_text", """SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice AS price, o_orderpriority AS priority, strftime(o_orderdate, '%d/%m/%Y') AS day, 'Ação' AS note FROM orders""")
def delimited(spark, sf):
    path = f"{scratch(spark)}/orders.csv"
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("price"),
                                          F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.lit("Ação").alias("note"))
    o.write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    return rd_.read_tables(spark, path).tables["orders"]


@query("source_quoted_text", """SELECT o_orderkey::DOUBLE AS code, strftime(o_orderdate, '%d/%m/%Y') || chr(10) || 'said "' || o_orderpriority || '", then; left' AS note, o_orderstatus AS code_2 FROM orders""")
def quoted(spark, sf):
    """Line breaks, quotes and separators inside cells and a repeated header, written as text and read in pieces."""
    path = f"{scratch(spark)}/notes.csv"
    said = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit('\nsaid "'), "o_orderpriority", F.lit('", then; left'))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("code"), said.alias("note"), F.col("o_orderstatus").alias("code "))
    rows.write.csv(path, header=True, sep=";", quoteAll=True, escape='"', ignoreTrailingWhiteSpace=False)
    return rd_.read_tables(spark, path).tables["notes"]


@query("source_typed_scan", """SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1""")
def typed(spark, sf):
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    schema = StructType([StructField("o_custkey", LongType()), StructField("o_totalprice", DoubleType())])
    d = rd_.read_typed(spark, f"{sf}/orders.parquet", schema, ["o_custkey", "o_totalprice"])
    return d.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query("sink_tables", "SELECT 'customer' AS tab, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def sink(spark, sf):
    paths = wr.write_tables({n: table(spark, sf, n) for n in ("customer", "orders")}, scratch(spark))
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tab"), "n") for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("sink_run_tables", "SELECT 'r1' AS run_id, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'r2', count(*) FROM customer")
def run_tables(spark, sf):
    c, path = table(spark, sf, "customer"), scratch(spark)
    wr.write_run({"queue": c}, path, "r1")
    wr.write_run({"queue": c}, path, "r2")
    out = wr.write_run({"queue": c.filter("c_acctbal >= 0")}, path, "r1")
    return spark.read.parquet(out["queue"]).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_panel_reload", f"WITH {E_SQL} SELECT client % 4 AS fold, count(*) AS n, sum(y)::BIGINT AS y FROM e_pan GROUP BY 1")
def panel_reload(spark, sf):
    path = scratch(spark)
    wr.write_panel(e_panel(spark, sf).select("client", "m", "y", F.pmod("client", F.lit(4)).alias("fold")), path)
    return wr.read_panel(spark, path).groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


# ---------------------------------------------------------------- profile and types
def _prof(t, c, dates=False):
    neg = f"count(*) FILTER ({c} < 0)::DOUBLE / nullif(count({c}), 0)" if c in ("c_acctbal", "c_custkey", "o_totalprice") else "0.0::DOUBLE"
    return (f"SELECT '{t}' AS tab, '{c}' AS col, count(*) AS \"rows\", count({c}) AS filled, count(DISTINCT {c}) AS \"distinct\", {rs(neg)} AS negative_share, "
            f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count FROM {t}")


@query("schema_profile", " UNION ALL ".join(_prof(t, c) for t, c in (("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_acctbal"), ("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("orders", "o_orderdate"))))
def profile(spark, sf):
    t = {"customer": table(spark, sf, "customer").drop("c_nationkey"), "orders": table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderdate")}
    return sc.profile_columns(sc.base_values(t)).select("tab", "col", "rows", "filled", "distinct", rd(F.coalesce("negative_share", F.lit(0.0)), 6, "negative_share"), "top_count")


@query("schema_examples", "SELECT 'c_mktsegment' AS col, array_to_string(list_sort(list(DISTINCT c_mktsegment))[1:3], ',') AS examples FROM customer")
def examples_q(spark, sf):
    v = sc.value_table("customer", table(spark, sf, "customer").select("c_mktsegment"))
    return sc.examples(v).select("col", F.array_join("examples", ",").alias("examples"))


@query("schema_column_types", """SELECT 'c_custkey' AS col, CASE WHEN count(DISTINCT c_custkey) >= 0.9*count(*) THEN 'id' ELSE 'numeric' END AS type FROM customer UNION ALL SELECT 'c_acctbal', 'numeric'
  UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) <= 2 THEN 'binary' WHEN count(DISTINCT c_mktsegment) <= 15 THEN 'category' ELSE 'text' END FROM customer
  UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) > 30 THEN 'text' ELSE 'category' END FROM customer UNION ALL SELECT 'c_nationkey', 'numeric'""")
def types(spark, sf):
    st = sc.infer_structure({"customer": table(spark, sf, "customer").drop("__")}, "customer", "c_custkey")
    return spark.createDataFrame(list(st.tables["customer"].types.items()), "col string, type string")


@query("schema_date_fraction", """SELECT 'day' AS col, 1.0::DOUBLE AS text_dates UNION ALL SELECT 'mixed', count(DISTINCT o_orderdate)::DOUBLE / (count(DISTINCT o_orderdate) + count(DISTINCT o_orderkey)) FROM orders UNION ALL SELECT 'status', 0.0""")
def date_fraction(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    # the distinct values of "mixed" are all days and all keys
    both = o.select(F.explode(F.array(day, F.col("o_orderkey").cast("string"))).alias("mixed"))
    p = sc.profile_columns(sc.base_values({"a": o.select(day.alias("day"), F.col("o_orderstatus").alias("status")), "b": both}))
    return p.select("col", "text_dates")


SMALL = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"]}
VALS_SQL = "v AS (" + " UNION ".join(f"SELECT '{t}' AS tab, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in SMALL.items() for c in cs) + ")"


@query("schema_containment", f"""WITH {VALS_SQL} SELECT a.tab AS a_tab, a.col AS a_col, b.tab AS b_tab, b.col AS b_col, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.tab <> b.tab GROUP BY 1, 2, 3, 4""")
def containment(spark, sf):
    return sc.containment(sc.base_values({t: table(spark, sf, t).select(*cs) for t, cs in SMALL.items()}))


@query("schema_key_share", f"""WITH k AS (SELECT 'orders' AS tab, 'o_orderkey' AS col, avg(CASE WHEN o_orderkey IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END) AS s FROM orders
   UNION ALL SELECT 'orders', 'o_custkey', avg(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END) FROM orders UNION ALL SELECT 'events', 'user_id', avg(CASE WHEN user_id IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END) FROM events)
  SELECT tab, col, {rs('s')} AS inside FROM k""")
def key_share(spark, sf):
    t = {"customer": table(spark, sf, "customer").select("c_custkey"), "orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
         "events": table(spark, sf, "events").select("user_id")}
    return sc.key_shares(sc.base_values(t), "customer", "c_custkey").select("tab", "col", rd("inside"))


ROLES_SQL = "SELECT 'customer' AS tab, 'clients' AS role, 'c_custkey' AS key, CAST(NULL AS VARCHAR) AS date_column UNION ALL SELECT 'orders', CASE WHEN max(n) <= 1 THEN 'static' ELSE 'temporal' END, 'o_custkey', 'o_orderdate' FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) UNION ALL SELECT 'visits', CASE WHEN max(n) <= 1 THEN 'static' ELSE 'events' END, 'user_id', NULL FROM (SELECT count(*) AS n FROM events GROUP BY user_id) UNION ALL SELECT 'first_order', 'static', 'client', NULL UNION ALL SELECT 'region', 'ignored', NULL, NULL"


def base_tables(spark, sf):
    o = table(spark, sf, "orders")
    return {"customer": table(spark, sf, "customer"), "orders": o.select("o_custkey", "o_orderdate", "o_totalprice"),
            "visits": table(spark, sf, "events").select("user_id", "event_type", "value"),
            "first_order": o.groupBy(F.col("o_custkey").alias("client")).agg(F.min("o_totalprice").alias("cheapest")), "region": table(spark, sf, "region").select("r_name")}


@query("schema_table_roles", ROLES_SQL)
def roles(spark, sf):
    st = sc.infer_structure(base_tables(spark, sf))
    return spark.createDataFrame([(i.name, i.role, i.key, i.date_column) for i in st.tables.values()], "tab string, role string, key string, date_column string")


def labelled_base(spark, sf):
    """Customers with a status table made from the event labels, and the event rows."""
    lab = e_labels(spark, sf)
    month = F.when(F.col("cancelled"), F.date_format(F.date_from_unix_date("exit_m"), "yyyy-MM-dd"))
    status = lab.select(F.col("client").alias("c_custkey"), F.when(F.col("cancelled"), "Cancelado").otherwise("Ativo").alias("situacao"), month.alias("data_saida"))
    clients = table(spark, sf, "customer").join(lab.select(F.col("client").alias("c_custkey")), "c_custkey", "left_semi")
    ev = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), "ts", "value", "event_type")
    spend = ev.groupBy("c_custkey").agg(F.round(F.avg("value"), 2).alias("valor_medio"))
    return {"clientes": clients.join(spend, "c_custkey").select("c_custkey", "c_mktsegment", "valor_medio"), "situacao": status, "uso": ev}


@query("schema_suggestions", "SELECT 'clientes' AS client_table, 'c_custkey' AS id_column, 'situacao' AS target_table, 'situacao' AS status_column, 'Cancelado' AS cancelled_value, 'data_saida' AS exit_column, 'clientes' AS value_table, 'valor_medio' AS value_column")
def suggestions(spark, sf):
    _, s, _ = sc.inspect_tables(labelled_base(spark, sf))
    row = (s["client_table"], s["id_column"], s["target"]["table"], s["target"]["status_column"], s["target"]["cancelled_value"], s["target"]["exit_column"],
           s["value"]["table"], s["value"]["column"])
    return spark.createDataFrame([row], "client_table string, id_column string, target_table string, status_column string, cancelled_value string, exit_column string, value_table string, value_column string")


@query("schema_inspect", f"""WITH {E_SQL} SELECT 'clientes' AS tab, 'c_custkey' AS col, 'id' AS type, 'clients' AS role, count(*) AS "rows", count(*) AS "distinct", 0.0::DOUBLE AS null_pct FROM e_lab
  UNION ALL SELECT 'situacao', 'situacao', 'binary', 'static', count(*), 2, 0.0 FROM e_lab UNION ALL SELECT 'situacao', 'data_saida', 'date', 'static', count(*), count(DISTINCT exit_m), round(100.0*(1 - count(exit_m)::DOUBLE/count(*)), 1) FROM e_lab
  UNION ALL SELECT 'uso', 'event_type', 'category', 'temporal', count(*), count(DISTINCT event_type), 0.0 FROM events""")
def inspect(spark, sf):
    d, _, _ = sc.inspect_tables(labelled_base(spark, sf))
    return d.filter(F.concat_ws(".", "tab", "col").isin("clientes.c_custkey", "situacao.situacao", "situacao.data_saida", "uso.event_type")).select(
        "tab", "col", "type", "role", "rows", "distinct", "null_pct")


@query("mapping_validation", f"""WITH {E_SQL} SELECT 'error' AS severity, 'O horizonte de previsão precisa ficar entre 1 e 12 meses.' AS detail
  UNION ALL SELECT 'error', 'O valor ''Perdido'' não aparece na coluna ''situacao'' (valores: ''Ativo'', ''Cancelado''). Informe o valor que significa cancelado.'
  UNION ALL SELECT 'error', concat('A coluna ''c_custkey'' tem ', (SELECT count(*) - count(DISTINCT user_id) FROM events), ' ID(s) repetido(s) na tabela ''uso'' (ex.: ', (SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT CAST(user_id AS VARCHAR) AS id FROM events GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 3)), '): escolha a tabela com uma linha por cliente.')
  UNION ALL SELECT 'error', 'A coluna de valor ''event_type'' não é numérica.' UNION ALL SELECT 'warning', 'Coluna ignorada ''nada'' não existe na base.'""")
def mapping_validation(spark, sf):
    m = mp.Mapping("uso", "c_custkey", "situacao", "situacao", "Perdido", "data_saida", "uso", "event_type", 13, ["nada"])
    return mp.problems_frame(spark, labelled_base(spark, sf), m)


@query("mapping_valid", f"""WITH {E_SQL} SELECT 'warning' AS severity, 'Só ' AS detail FROM e_lab WHERE false""")
def mapping_valid(spark, sf):
    m = mp.Mapping("clientes", "c_custkey", "situacao", "situacao", "Cancelado", "data_saida", "clientes", "valor_medio")
    return mp.problems_frame(spark, labelled_base(spark, sf), m)


__all__ = ["month_label"]
