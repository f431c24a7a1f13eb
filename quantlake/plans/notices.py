"""Announcements, renames and holidays taken from the given tables, so that what reads them grows with the data.

An order is a notice about a symbol on its day; its keys choose the kind and the numbers in its text. A supplier's name may change,
some in a ring. The texts are put together by the same expressions in both dialects; what is made of them is written apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.plans.calendar import CLOSED, as_raw
from quantlake.plans.gate import CANONICAL, missing_columns
from quantlake.plans.labels import combinatorial
from quantlake.plans.market import ACTIONS_SQL, PARSED_SQL, PRICE_KINDS, C, parse_purpose, query
from quantlake.plans.panel import FEATURES_SQL, LAST, feature_columns, with_features
from quantlake.plans.panel import FEATURES as PANEL_FEATURES
from quantlake.plans.refit import PATHS, days_of, design
from quantlake.plans.chains import placed
from quantlake.plans.daygate import day_files
from quantlake.plans.scalars import expected_range
from quantlake.plans.serving import HORIZON, described, horizon_text, newest
from quantlake.plans.serving import _label as LABELS
from quantlake.plans.serving import _plain as plain_name
from quantlake.plans.store import corrected, read_actions
from quantlake.sources.bars import DAY, bars, bars_sql, dirty_sql, read
from quantlake.sources.files import has_data, scratch
from quantlake.sources.layouts import DELIVERY, EQUITY, UNIFIED

#: Texts of a notice by o_orderkey % 16, over the numbers x (2 to 10) and y (1 to 10).
TEXTS = (
    "concat('FACE VALUE SPLIT FROM RS ', x, '/- TO RS ', y, '/-')", "concat('BONUS ', y, ':', x)", "concat('Split from Rs. ', x, '.50 to Re ', y)", "concat('SUB-DIVISION FROM RS ', x, ' TO RE ', y)",
    "concat('RIGHTS ', y, ':', x, ' @ PREMIUM RS 90/-')", "'SCHEME OF ARRANGEMENT'", "'DEMERGER OF A UNIT'", "'DELISTED'", "concat('CHANGE IN NAME TO BRAND', x)", "concat('ANNUAL GENERAL MEETING / DIVIDEND RS ', y, '.50 PER SHARE')",
    "'SOMETHING UNEXPECTED'", "concat('BONUS ISSUE ', y, ' : ', x)", "concat('Amalgamation and bonus ', x, ':', y)", "'NAME CHANGE'", "concat('INTERIM DIVIDEND ', x)", "'SPIN-OFF'",
)
TEXT = "CASE o_orderkey % 16 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TEXTS)) + " END"
NUMBERS = "concat('Brand#', 1 + o_custkey % 25) AS symbol, CAST(o_orderdate AS DATE) AS ex_date, o_orderkey, 2 + o_orderkey % 9 AS x, 1 + o_custkey % 10 AS y"
NOTICES = PARSED_SQL.replace(ACTIONS_SQL, f"o AS (SELECT {NUMBERS} FROM orders), actions AS (SELECT symbol, ex_date, {TEXT} AS purpose FROM o)")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ex_date and purpose of every order."""
    rows = read(spark, sf_dir, "orders").selectExpr(*columns_of(NUMBERS))
    return rows.selectExpr("symbol", "ex_date", f"{TEXT} AS purpose")


def columns_of(text: str) -> list[str]:
    """The parts of a list of columns, cut at commas outside brackets."""
    out, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices, written out as they would come, and what they say. Read back, the text is a column: the optimizer would put its whole
    expression into each of the patterns' tests."""
    path = scratch(spark, "notices")
    notices(spark, sf_dir).write.parquet(path)
    return parse_purpose(spark.read.parquet(path))


def is_priced() -> Column:
    return C("kind").isin(*PRICE_KINDS) & (C("ratio") != 1)


query("fn_parse_purpose", f"WITH {NOTICES} SELECT symbol, ex_date, kind, round(ratio, 10) AS ratio, confident, purpose FROM parsed")(lambda s, d: parsed(s, d).withColumn("ratio", F.round("ratio", 10)))
query("fn_regex_set", f"WITH {NOTICES} SELECT kind, count(*) AS n, count(*) FILTER (confident) AS confident FROM parsed GROUP BY kind")(
    lambda s, d: parsed(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("confident").alias("confident"))
)
query("fn_affects_price", f"WITH {NOTICES} SELECT symbol, ex_date, purpose, kind IN {PRICE_KINDS} AND ratio <> 1 AS affects_price FROM parsed")(
    lambda s, d: parsed(s, d).select("symbol", "ex_date", "purpose", is_priced().alias("affects_price"))
)
query("fn_actions_from_frame", f"WITH {NOTICES} SELECT upper(trim(symbol)) AS symbol, ex_date, kind, round(ratio, 10) AS ratio FROM parsed WHERE confident")(
    lambda s, d: parsed(s, d).where("confident").select(F.upper(F.trim("symbol")).alias("symbol"), "ex_date", "kind", F.round("ratio", 10).alias("ratio"))
)
query("fn_rename_events", f"WITH {NOTICES} SELECT symbol AS old_symbol, CAST(NULL AS VARCHAR) AS new_symbol, ex_date AS effective_date, true AS needs_review FROM parsed WHERE kind = 'symbol_change'")(
    lambda s, d: parsed(s, d).where("kind = 'symbol_change'").select(C("symbol").alias("old_symbol"), F.lit(None).cast("string").alias("new_symbol"), C("ex_date").alias("effective_date"), F.lit(True).alias("needs_review"))
)
query("gate_action_index", f"WITH {NOTICES} SELECT symbol, ex_date, round(ratio, 8) AS ratio FROM act")(
    lambda s, d: parsed(s, d).where(C("confident") & is_priced()).groupBy("symbol", "ex_date").agg(F.round(F.product("ratio"), 8).alias("ratio"))
)

# Notices as CSV files, read again with headers as they come


def notice_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "notices")
    notices(spark, sf_dir).select(F.lower("symbol").alias(" Symbol "), C("ex_date").alias("EX_DATE"), C("purpose").alias(" Purpose")).write.option("header", True).csv(path)
    return path


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices as stored, parsed anew from their text; only confident ones."""
    path = scratch(spark, "stored-notices")
    read_actions(spark, notice_files(spark, sf_dir)).select("symbol", "ex_date", "purpose").write.parquet(path)
    return parse_purpose(spark.read.parquet(path)).where("confident")


query("src_actions_csv", f"WITH {NOTICES} SELECT upper(symbol) AS symbol, ex_date, kind, round(ratio, 10) AS ratio, confident FROM parsed")(
    lambda s, d: read_actions(s, notice_files(s, d)).drop("purpose").withColumn("ratio", F.round("ratio", 10))
)
query("src_actions_reload", f"WITH {NOTICES} SELECT upper(symbol) AS symbol, ex_date, kind, round(ratio, 10) AS ratio FROM parsed WHERE confident")(
    lambda s, d: reloaded(s, d).select("symbol", "ex_date", "kind", F.round("ratio", 10).alias("ratio"))
)

# Holidays: every 61st day of the year on which orders were placed, as one JSON object by year


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "orders").select(C("o_orderdate").cast("date").alias("date")).distinct().where(F.dayofyear("date") % 61 == 5)
    years = days.groupBy(F.year("date").cast("string").alias("year")).agg(F.array_sort(F.collect_list(C("date").cast("string"))).alias("dates"))
    whole = years.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("year", "dates")))).alias("value"))  # a few days a year
    path = scratch(spark, "holidays")
    whole.write.text(path)
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m")).select(F.explode("m").alias("year", "dates"))
    return rows.select(C("year").cast("int").alias("year"), F.explode(F.transform("dates", lambda x: x.cast("date"))).alias("date"))


query("src_holidays_json", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS date FROM orders WHERE dayofyear(o_orderdate) % 61 = 5")(holidays)
query(
    "fn_expected_range",
    f"WITH r AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders), d AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM r) SELECT date FROM d WHERE isodow(date) < 6 AND strftime(date, '%m-%d') NOT IN {CLOSED}",
)(lambda s, d: expected_range(s, *map(str, read(s, d, "orders").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first())))
query("fn_horizon_text", f"SELECT DISTINCT CAST(l_quantity AS INTEGER) AS months, CASE CAST(l_quantity AS INTEGER) {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in HORIZON.items())} ELSE CAST(l_quantity AS INTEGER) || ' months' END AS text FROM lineitem")(
    lambda s, d: read(s, d, "lineitem").select(C("l_quantity").cast("int").alias("months")).distinct().select("months", horizon_text(C("months")).alias("text"))
)

# Renamed suppliers: the earliest edge of a name in force counts; a chain of renames ends where it would come back

IN_FORCE = "1998-01-01"
RENAMED = """SELECT concat('S', s_suppkey) AS old, concat('S', CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey - 2 ELSE s_suppkey + 1 END) AS new, CAST('1994-01-01' AS DATE) + CAST(s_suppkey * 13 % 2000 AS INT) AS effective FROM supplier WHERE s_suppkey % 5 <> 0
    UNION ALL SELECT concat('S', s_suppkey), concat('T', s_suppkey), CAST('1996-01-01' AS DATE) + CAST(s_suppkey * 7 % 1000 AS INT) FROM supplier WHERE s_suppkey % 3 = 0"""


def resolved(edges: DataFrame, most: int = 64) -> DataFrame:
    """old and its present name for every old of ``edges`` (old, new, effective): of several edges of a name the earliest counts. Each
    round follows one more edge, until no chain goes on; ``most`` rounds at the most. The frame is written each round."""
    spark = edges.sparkSession
    edges = edges.groupBy("old").agg(F.min_by("new", "effective").alias("new"))
    step = edges.select(C("old").alias("from"), C("new").alias("to"))
    found = edges.select("old", "new", F.array("old", "new").alias("path"), F.lit(True).alias("open"))
    for _ in range(most):
        onward = C("open") & C("to").isNotNull() & ~F.array_contains("path", C("to"))
        joined = found.join(step, C("new") == C("from"), "left").withColumn("go", F.coalesce(onward, F.lit(False)))
        again = joined.select("old", F.when(C("go"), C("to")).otherwise(C("new")).alias("new"), F.when(C("go"), F.array_append("path", C("to"))).otherwise(C("path")).alias("path"), C("go").alias("open"))
        path = scratch(spark, "names")
        again.write.parquet(path)
        found = spark.read.parquet(path)
        if found.where("open").isEmpty():
            break
    return found.select("old", "new")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(C("s_suppkey").alias("k"))
    s = lambda x: F.concat(F.lit("S"), x)
    later = lambda day, n: F.date_add(F.lit(day).cast("date"), n.cast("int"))
    one = rows.where("k % 5 <> 0").select(s(C("k")).alias("old"), s(F.when(C("k") % 11 == 0, C("k") - 2).otherwise(C("k") + 1)).alias("new"), later("1994-01-01", C("k") * 13 % 2000).alias("effective"))
    two = rows.where("k % 3 = 0").select(s(C("k")).alias("old"), F.concat(F.lit("T"), C("k")).alias("new"), later("1996-01-01", C("k") * 7 % 1000).alias("effective"))
    return resolved(one.unionByName(two).where(C("effective") <= IN_FORCE))


RENAMES = f"""WITH RECURSIVE moved AS ({RENAMED}), edges AS (SELECT old, new FROM moved WHERE effective <= DATE '{IN_FORCE}' QUALIFY row_number() OVER (PARTITION BY old ORDER BY effective) = 1),
    c(old, new, path) AS (SELECT old, new, [old, new] FROM edges UNION ALL SELECT c.old, e.new, list_append(c.path, e.new) FROM c JOIN edges e ON e.old = c.new WHERE NOT list_contains(c.path, e.new)), names AS (SELECT old, arg_max(new, len(path)) AS new FROM c GROUP BY old)"""
query("join_rename_forward", f"{RENAMES} SELECT old, new FROM names")(names)
query("join_rename_chain", f"{RENAMES} SELECT new AS symbol, array_to_string(list_sort(list(old)), ',') AS earlier FROM names WHERE new <> old GROUP BY new")(
    lambda s, d: names(s, d).where("new <> old").groupBy(C("new").alias("symbol")).agg(F.array_join(F.sort_array(F.collect_set("old")), ",").alias("earlier"))
)
query("join_canonicalise", f"{RENAMES}, asked AS (SELECT 'S' || l_suppkey AS symbol, min(l_orderkey * 8 + l_linenumber) AS k FROM lineitem GROUP BY 1) SELECT symbol, place FROM (SELECT coalesce(new, symbol) AS symbol, min(k) AS place FROM asked LEFT JOIN names ON old = symbol GROUP BY 1)")(
    lambda s, d: read(s, d, "lineitem").groupBy(F.concat(F.lit("S"), C("l_suppkey")).alias("symbol")).agg(F.min(C("l_orderkey") * 8 + C("l_linenumber")).alias("k")).join(names(s, d), C("symbol") == C("old"), "left")
    .groupBy(F.coalesce("new", "symbol").alias("symbol")).agg(F.min("k").alias("place"))
)

# Columns with what is in them

query(
    "T1_structural_schema",
    f"{dirty_sql(DAY)}, p AS (SELECT *, 'EQ' AS series, CASE WHEN volume <> 0 THEN delivery_qty * 100.0 / volume END AS delivery_pct, 'IN' AS isin FROM dirty) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, true AS present, count({c}) AS n FROM p" for c in CANONICAL),
)(lambda s, d: counted(day_files(s, d), list(CANONICAL)))


def counted(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """column_name, present and n (values that are not null) of each of ``wanted``; a column that is not there has 0."""
    lacking = set(missing_columns(rows))
    counts = rows.agg(*((F.lit(0).cast("long") if c in lacking else F.count(c)).alias(c) for c in wanted))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(c not in lacking).alias("present"), C(c).alias("n")) for c in wanted))).alias("f")).select("f.*")


def filled(rows: DataFrame, names: list[str]) -> DataFrame:
    counts = rows.agg(*(F.count(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c.strip()).alias("name"), C(f"_{k}").alias("n")) for k, c in enumerate(names)))).alias("f")).select("f.*")


COLUMNS = ["delivery_pct", *PANEL_FEATURES]
query("prj_feature_cols", f"{FEATURES_SQL} " + " UNION ALL ".join(f"SELECT '{x}' AS feature, count({x}) AS n FROM {LAST}" for x in COLUMNS))(
    lambda s, d: (lambda rows: filled(rows, feature_columns(rows)).withColumnRenamed("name", "feature"))(with_features(bars(s, d, DAY)))
)
query("nrm_header_clean", f"{bars_sql()} " + " UNION ALL ".join(f"SELECT '{k}' AS header, count({'*' if v in ('series', 'delivery_qty', 'delivery_pct') else v}) AS n FROM bars" for k, v in DELIVERY.items()))(
    lambda s, d: (lambda raw: filled(raw, [c for c in raw.columns if c != "date"]).select(F.upper("name").alias("header"), "n"))(as_raw(s, d, DELIVERY))
)
query("nrm_is_delivery", f"{bars_sql()} SELECT layout, is_delivery, count(*) AS n FROM bars, (VALUES ('equity', false), ('delivery', true), ('unified', false)) AS v(layout, is_delivery) GROUP BY ALL")(
    lambda s, d: (lambda frames: frames[0].unionByName(frames[1]).unionByName(frames[2]))(
        [(lambda raw: raw.agg(F.count("*").alias("n")).select(F.lit(k).alias("layout"), F.lit("TURNOVER_LACS" in [c.strip().upper() for c in raw.columns]).alias("is_delivery"), "n"))(as_raw(s, d, v)) for k, v in {"equity": EQUITY, "delivery": DELIVERY, "unified": UNIFIED}.items()]
    )
)


def years_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year and has_data of each year from the first to the one after the last: whether its folder in the lake holds data."""
    path = corrected(spark, sf_dir)
    a, b = bars(spark, sf_dir, DAY).agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    return spark.createDataFrame([(y, has_data(spark, f"{path}/year={y}")) for y in range(a, b + 2)], "year int, has_data boolean")


query("src_has_data", f"{bars_sql(DAY)}, y AS (SELECT unnest(range(min(year(date)), max(year(date)) + 2)) AS year FROM bars) SELECT CAST(year AS INTEGER) AS year, year IN (SELECT year(date) FROM bars) AS has_data FROM y")(years_kept)
_plain = " ".join(f"WHEN '{x}' THEN '{LABELS.get(x, plain_name(x))}'" for x in PANEL_FEATURES)
query(
    "fn_describe",
    f"{FEATURES_SQL}, nw AS (SELECT * FROM {LAST} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), u AS ({' UNION ALL '.join(f'SELECT symbol, {chr(39)}{x}{chr(39)} AS feature FROM nw WHERE {x} IS NOT NULL' for x in PANEL_FEATURES)}) SELECT symbol, feature, CASE feature {_plain} END AS name FROM u",
)(lambda s, d: newest(with_features(bars(s, d, DAY))).select("symbol", F.explode(F.array_compact(F.array(*(F.when(C(x).isNotNull(), F.lit(x)) for x in PANEL_FEATURES)))).alias("feature")).select("symbol", "feature", described(C("feature")).alias("name")))
query("cv_cpcv_counts", f"{PATHS.split(', e0 AS')[0]}, n AS (SELECT date, count(*) AS splits, count(grp) AS paths FROM dr GROUP BY date) SELECT splits, paths, count(*) AS days FROM n GROUP BY ALL")(
    lambda s, d: combinatorial(days_of(design(placed(s, d)))).groupBy("date").agg(F.count("*").alias("splits"), F.count_if(C("role") == "test").alias("paths")).groupBy("splits", "paths").agg(F.count("*").alias("days"))
)
