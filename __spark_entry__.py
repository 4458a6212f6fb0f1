"""Queries over the benchmark tables and the SQL that must give the same rows."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

from runwise import fixtures as fx, functions as fn, operators as op, plans, sources as src
from runwise.schemas import PERSON_COLUMNS
from runwise.session import scratch_path
from runwise.sources import pools


def entry(spark: SparkSession) -> DataFrame:
    """Memory prediction per application, from task-end events."""
    return q_combine_predictions(spark, "/root/testdata/sf0.001")


# --- telemetry ---------------------------------------------------------------

def _tasks(spark, d):
    return op.task_metrics(fx.task_end_events(spark, d))


def _metrics(spark, d):
    return op.app_metrics(_tasks(spark, d))


def q_task_metrics(spark, d):
    return _tasks(spark, d)


def q_task_bytes(spark, d):
    return op.task_bytes(_tasks(spark, d)).groupBy("application_attempt").agg(
        F.max("bytes_all").alias("max_bytes_all")
    )


def q_task_peak_memory(spark, d):
    return op.task_peak_memory(_tasks(spark, d)).groupBy("application_attempt").agg(
        F.max("peak_mem").alias("max_peak_mem")
    )


def q_app_metrics(spark, d):
    return _metrics(spark, d)


def q_predict_gc(spark, d):
    return op.predict_gc(_metrics(spark, d))


def q_predict_spill(spark, d):
    return op.predict_spill(_metrics(spark, d))


def q_predict_footprint(spark, d):
    return op.predict_footprint(_metrics(spark, d))


def q_combine_predictions(spark, d):
    return op.combine_predictions(_metrics(spark, d))


def q_to_mib(spark, d):
    p = op.combine_predictions(_metrics(spark, d))
    return p.select("application_attempt", fn.to_mib(F.col("prediction")).alias("prediction_mb"))


def _event_logs(spark, d):
    """The derived events as JSON logs on disk, read back."""
    path = scratch_path(spark, "event_logs")
    src.write_event_logs(fx.log_events(spark, d), path)
    return src.read_event_logs(spark, path)


def q_read_event_logs(spark, d):
    return op.app_metrics(op.task_metrics(_event_logs(spark, d)))


def q_app_durations(spark, d):
    return op.app_durations(_event_logs(spark, d))


def q_effective_conf(spark, d):
    return op.effective_conf(_event_logs(spark, d))


# --- configuration logs ------------------------------------------------------

def _records(spark, d):
    return src.config_record(fx.config_runs(spark, d), fx.CONFIG_FIELDS)


def _config_logs(spark, d):
    path = scratch_path(spark, "config_logs")
    # Every run is logged twice, first with another memory size; the later record counts.
    first = _records(spark, d).withColumn("record", F.expr("transform_values(record, (k, v) -> if(k = 'spark_executor_memory', '7g', v))"))
    src.write_config_log(first, path)
    src.write_config_log(_records(spark, d), path)
    # A foreign file in the folder must not disturb the reader.
    fx.table(spark, d, "supplier").select(F.col("s_name").alias("value")).write.mode("append").text(path)
    return src.read_config_logs(spark, path)


def q_config_record(spark, d):
    return _records(spark, d).select("application_attempt", F.explode("record").alias("key", "value"))


def q_read_config_logs(spark, d):
    return _config_logs(spark, d).select(
        "application_attempt", "spark_executor_memory",
        F.col("record")["limit"].alias("limit_rows"),
        F.col("record")["spark.sql.shuffle.partitions"].alias("shuffle_partitions"),
        F.size("record").cast("bigint").alias("entries"),
    )


def _points(spark, d):
    return op.training_points(op.combine_predictions(_metrics(spark, d)), _config_logs(spark, d))


def q_training_points(spark, d):
    return _points(spark, d)


def q_trial_table(spark, d):
    return op.trial_table(
        _config_logs(spark, d), op.app_durations(_event_logs(spark, d)), "spark.sql.shuffle.partitions"
    )


def q_analyze_runs(spark, d):
    events, configs = scratch_path(spark, "event_logs"), scratch_path(spark, "config_logs")
    src.write_event_logs(fx.log_events(spark, d), events)
    src.write_config_log(_records(spark, d), configs)
    result = plans.analyze_runs(spark, events, configs, scratch_path(spark, "points"))
    return result.probe.select("rows", F.round("prediction", 3).alias("prediction"), "memory_prediction")


# --- curve -------------------------------------------------------------------

def _priced(spark, d):
    """Quantity as feature and price as label of every line item."""
    return fx.table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("rows"), F.col("l_extendedprice").alias("mem"), "l_linestatus"
    )


def _rounded(curve, frame):
    p = op.predict_curve(curve, frame)
    return p.select("rows", F.round("prediction", 4).alias("prediction"))


def q_fit_curve(spark, d):
    priced = _priced(spark, d)
    curve = _rounded(op.fit_curve(priced), priced.select("rows").distinct())
    return curve.withColumnRenamed("rows", "boundary")


def q_fit_curve_wide(spark, d):
    """The same curve, cut until a task has four points."""
    priced = _priced(spark, d)
    curve = _rounded(op.fit_curve(priced, local_points=4), priced.select("rows").distinct())
    return curve.withColumnRenamed("rows", "boundary")


def q_fit_curve_cut(spark, d):
    """Prices over customer groups, a curve of far more points than a task may fit."""
    orders = fx.table(spark, d, "orders").selectExpr("cast(o_custkey div 10 as double) rows", "o_totalprice mem")
    return _rounded(op.fit_curve(orders, local_points=5), orders.select("rows").distinct())


def _parts_on(curve, spark, d):
    grid = fx.table(spark, d, "part").selectExpr("p_partkey", "cast(p_size * 1.25 - 3 as double) rows")
    p = op.predict_curve(curve, grid)
    return p.select("p_partkey", "rows", F.round("prediction", 4).alias("prediction"))


def q_predict_curve(spark, d):
    return _parts_on(op.fit_curve(_priced(spark, d)), spark, d)


def q_predict_curve_wide(spark, d):
    return _parts_on(op.fit_curve(_priced(spark, d), local_points=4), spark, d)


def _old_and_new(spark, d):
    priced = _priced(spark, d)
    new = "l_linestatus = 'O' and rows > 25"
    kept = scratch_path(spark, "kept_curve")
    op.write_curve(op.fit_curve(priced.filter(f"not ({new})")), kept)
    return op.read_curve(spark, kept), priced.filter(new)


def q_merge_curve(spark, d):
    merged = op.merge_curve(*_old_and_new(spark, d))
    return merged.select("rows", F.round("mem", 4).alias("mem"))


def q_refit_curve(spark, d):
    old, new = _old_and_new(spark, d)
    grid = _priced(spark, d).select("rows").distinct()
    return _rounded(op.refit_curve(old, new), grid)


# --- functions ---------------------------------------------------------------

def _customers(spark, d, text, name):
    """Customers with a string put together in SQL."""
    columns = f"c_custkey, {text.format(text='string')} {name}"
    return spark.sql(f"select {columns} from {{t}}", t=fx.table(spark, d, "customer"))


def q_memory_to_bytes(spark, d):
    sized = _customers(spark, d, _SIZE, "size")
    return sized.select("c_custkey", "size", fn.memory_to_bytes(F.col("size")).alias("bytes"))


def q_parse_params(spark, d):
    given = _customers(spark, d, _PARAMS, "params")
    return given.select("c_custkey", F.explode(fn.parse_params(F.col("params"))).alias("key", "value"))


# --- workload ----------------------------------------------------------------

def q_derive_persons(spark, d):
    return op.derive_persons(fx.person_rows(spark, d)).select("phone", "fio", "address", "document")


def q_prefix_columns(spark, d):
    people = op.derive_persons(fx.person_rows(spark, d)).drop("fio", "document")
    return op.prefix_columns(people)


def q_value_counts(spark, d):
    return op.value_counts(fx.table(spark, d, "events"), "event_type")


def q_value_counts_top(spark, d):
    return op.value_counts(fx.table(spark, d, "orders"), "o_custkey", limit=20)


def q_row_count(spark, d):
    return op.row_count(fx.table(spark, d, "lineitem"))


def q_partition_profile(spark, d):
    """Rows of each filled partition; each of the tables is one row group, and so one of them."""
    parts = [fx.table(spark, d, t).select(F.lit(1).alias("one")) for t in ("lineitem", "orders", "customer")]
    return op.partition_profile(parts[0].union(parts[1]).union(parts[2])).select("rows")


def q_self_join(spark, d):
    return op.self_join(fx.person_rows(spark, d), "surname")


def q_self_join_grid(spark, d):
    """The same join with every busy key spread over a grid."""
    people = fx.person_rows(spark, d)
    # the busiest key has a share of the rows whatever the scale, so this spreads some
    return op.self_join(people, "surname", rows_per_task=max(50, people.count() // 40))


def q_self_join_factored(spark, d):
    """The same join from blocks of rows, several to each busy key."""
    people = fx.person_rows(spark, d)
    other = op.prefix_columns(people, people.columns)
    return op.expand_pairs(op.factor_join(people, other, "surname", "another_surname", block_rows=16, blocks_per_cell=2))


def q_join_size(spark, d):
    c = fx.table(spark, d, "customer")
    size = op.join_size(c, op.prefix_columns(c, c.columns), "c_mktsegment", "another_c_mktsegment")
    return size.select(F.col("pairs").cast("bigint").alias("pairs"))


def q_run_workload(spark, d):
    path = scratch_path(spark, "workload")
    result = plans.run_workload(fx.person_rows(spark, d), path)
    written = spark.read.parquet(path)

    def fact(name, df, value):
        return df.select(F.lit(name).alias("fact"), value.cast("bigint").alias("value"))

    return (
        fact("rows", result.rows, F.col("rows"))
        .union(fact("pairs", result.joined_rows, F.col("pairs")))
        .union(fact("written", written, F.count("*")))
        .union(fact("address_chars", written, F.sum(F.length("another_address"))))
        .union(fact("most_frequent", op.value_counts(fx.person_rows(spark, d), "surname", limit=1), F.col("count")))
    )


def q_run_workload_without_join(spark, d):
    result = plans.run_workload(fx.person_rows(spark, d), scratch_path(spark, "workload"), need_to_join=False)
    assert result.joined_rows is None
    return result.counts.select("surname", "count").join(result.other_counts.withColumnRenamed("count", "other"), F.col("surname") == F.col("another_surname"))


def q_generate_persons(spark, d):
    return src.generate_persons(fx.table(spark, d, "orders"), "o_orderkey")


def q_write_table(spark, d):
    path = scratch_path(spark, "table")
    src.write_table(fx.table(spark, d, "customer"), "parquet", path)
    return src.read_table(spark, "parquet", path)


def q_read_table(spark, d):
    path = scratch_path(spark, "table")
    src.write_table(fx.table(spark, d, "customer"), "csv", path)
    return src.read_table(spark, "csv", path).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


def q_read_table_inferred(spark, d):
    path = scratch_path(spark, "table")
    src.write_table(fx.table(spark, d, "customer"), "csv", path)
    return op.value_counts(src.read_table(spark, "csv", path, infer=True), "c_nationkey")


def q_parquet_footers(spark, d):
    footers = src.parquet_footers(spark, d)
    return footers.select(
        F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"), "num_rows", "num_columns"
    )


def q_parquet_profile(spark, d):
    return src.parquet_profile(src.parquet_footers(spark, d)).select(
        "total_num_rows", "max_num_columns", (F.col("total_serialized_size") > 0).alias("has_footers")
    )


# --- trials ------------------------------------------------------------------

def q_trial_stats(spark, d):
    stats = op.trial_stats(fx.trial_rows(spark, d))
    return stats.withColumn("avg", F.round("avg", 4))


def q_best_trial(spark, d):
    return op.best_trial(fx.trial_rows(spark, d))


def _more() -> tuple[dict, dict]:
    """Queries and SQL of the document operators and their pipeline, where those are there."""
    found, sql = {}, {}
    try:
        from runwise.llm.queries import QUERIES, SQL

        found, sql = dict(QUERIES), dict(SQL)
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith(("runwise.llm", "corpus_pipeline")):
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")} | _more()[0]


# --- the same in SQL ---------------------------------------------------------

_SIZE = """cast(c_custkey as {text}) || case c_custkey % 9
    when 0 then 'g' when 1 then 'm' when 2 then 'k' when 3 then 'G' when 4 then 'gb' when 5 then ''
    when 6 then '.5g' when 7 then ' m' end"""

_PARAMS = """case c_custkey % 6
    when 0 then concat('a=', cast(c_custkey as {text}), ';b=2')
    when 1 then concat('a=1;a=', cast(c_custkey as {text}))
    when 2 then concat('a=b=', cast(c_custkey as {text}), ';x')
    when 3 then concat('=', cast(c_custkey as {text}), ';k=')
    when 4 then '' end"""

_TASKS = f"(select {fx.TASK_SQL} from lineitem)"

_TASK_ROWS = f"""select application_attempt, launch_time, finish_time, jvm_gc_time, mem_spill, disk_spill,
    input_read, remote_read, result_size, shuffle_written, local_read, remote_to_disk, output_written,
    cast(has_peak as int) has_peak, peak from {_TASKS} t"""

_APPS = f"""select application_attempt,
    cast(sum(finish_time - launch_time) as bigint) total_duration,
    cast(sum(jvm_gc_time) as bigint) total_gc,
    max(mem_spill) mem_spill, max(disk_spill) disk_spill,
    max(input_read + remote_read + result_size + shuffle_written + local_read + remote_to_disk + output_written)
      max_bytes_all,
    max(peak) max_peak_mem, max(has_peak) has_peak
  from ({_TASK_ROWS}) t group by application_attempt"""

_P1 = "(cast(total_gc as double) / total_duration - cast(0.1 as double)) * 1073741824"
_P2 = "(mem_spill + disk_spill) / cast(2 as double)"
_P3 = "cast(max_bytes_all + max_peak_mem as double) / 1073741824 - (cast(0.6 as double) / 2) * 1073741824"

_PREDICTIONS = f"""select *, least(prediction1, prediction2, prediction3) prediction from (
    select application_attempt, {_P1} prediction1, {_P2} prediction2, {_P3} prediction3
    from ({_APPS}) a where has_peak = 1) p"""

_CONFIGS = f"""select *,
    case when spark_executor_memory like '%g' then cast(replace(spark_executor_memory, 'g', '') as bigint) * 1073741824
         when spark_executor_memory like '%m' then cast(replace(spark_executor_memory, 'm', '') as bigint) * 1048576
         else cast(spark_executor_memory as bigint) end memory_bytes,
    case s_suppkey % 3 when 0 then '1000' when 1 then '150' else '300' end shuffle_partitions
  from (select s_suppkey, {fx.CONFIG_SQL} from supplier where s_suppkey <> 7)"""

_POINTS = f"""select application_attempt, prediction + memory_bytes mem, cast(row_limit as double) "rows"
  from ({_PREDICTIONS}) p join ({_CONFIGS}) c using (application_attempt)"""

_PRICED = 'select l_quantity "rows", l_extendedprice mem, l_linestatus from lineitem'


def _isotonic(points: str) -> str:
    """Min-max formula over the distinct features of ``points(rows, mem)``: cv(x, y)."""
    return f"""g as (select "rows" x, sum(mem) t, count(*) w from ({points}) p group by 1),
      c as (select row_number() over (order by x) i, x,
              sum(t) over (order by x) st, sum(w) over (order by x) sw from g),
      blk as (select a.i ai, b.i bi, (b.st - coalesce(p.st, 0)) / (b.sw - coalesce(p.sw, 0)) m
              from c a join c b on a.i <= b.i left join c p on p.i = a.i - 1),
      mn as (select c.i, c.x, blk.ai, min(blk.m) m
             from c join blk on blk.ai <= c.i and blk.bi >= c.i group by 1, 2, 3),
      cv as (select x, max(m) y from mn group by x)"""


_LOOKUP = """lo as (select r, max(x) xl, arg_max(y, x) yl from q join cv on x <= r group by r),
      hi as (select r, min(x) xh, arg_min(y, x) yh from q join cv on x >= r group by r),
      fit as (select r, case when yl is null then yh when yh is null then yl when xh = xl then yl
               else yl + (yh - yl) * (r - xl) / (xh - xl) end y
             from q left join lo using (r) left join hi using (r))"""

_FIT = f"with {_isotonic(_PRICED)} select x boundary, round(y, 4) prediction from cv"

_PREDICT = f"""with {_isotonic(_PRICED)},
      q as (select distinct cast(p_size * 1.25 - 3 as double) r from part), {_LOOKUP}
    select p_partkey, r "rows", round(y, 4) prediction
    from part join fit on r = cast(p_size * 1.25 - 3 as double)"""

# Boundaries of a fitted curve are the ends of its constant stretches.
_OLD_CURVE = f"""select x "rows", y mem from (
    select *, lag(y) over (order by x) before, lead(y) over (order by x) after from
      (with {_isotonic(_PRICED + " where not (l_linestatus = 'O' and l_quantity > 25)")} select * from cv))
  where before is null or after is null or y - before > 1e-6 or after - y > 1e-6"""

_NEW_POINTS = f"""select "rows", mem from ({_PRICED}) where l_linestatus = 'O' and "rows" > 25"""

_MERGED = f"""{_NEW_POINTS} union all
  select "rows", mem from ({_OLD_CURVE}) o where "rows" not in (select "rows" from ({_NEW_POINTS}) n)"""

_DUCK_PERSON = fx.PERSON_SQL.replace("date_format(o_orderdate, 'd.M.yyyy')", "strftime(o_orderdate, '%-d.%-m.%Y')")

_PERSONS = f"(select {_DUCK_PERSON} from orders)"

_ADDRESS = "concat_ws(',', street, city)"

_SELF_JOIN = f"""select {", ".join(f"a.{c}, b.{c} another_{c}" for c in PERSON_COLUMNS)}
  from {_PERSONS} a join {_PERSONS} b on a.surname = b.surname"""

_DURATIONS = f"""select application_attempt, max(finish_time) - min(launch_time) duration_ms
  from {_TASKS} t group by application_attempt"""

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
           "benchmark labels conversations").split()

_FOOTERS = " union all ".join(
    f"""select '{t}' "name", (select count(*) from {t}) num_rows,
      (select count(*) from information_schema.columns where table_name = '{t}') num_columns""" for t in _TABLES
)


# Written down here, not taken from the code that the SQL is held against.
_PRIME = 2147483647
_STREAMS = [
    (1293655194, 1670264734, 645585956),
    (985352962, 1087103376, 1261391282),
    (485993904, 1267783083, 1121589885),
    (769194507, 569087823, 387584076),
    (380405989, 572343010, 953517081),
    (637899838, 1901223551, 915144700),
    (623019051, 45693207, 1915386542),
    (1429568534, 192247300, 2091186617),
    (1097898857, 1509639944, 1802549187),
    (485512312, 1237639612, 520094257),
    (1847771417, 2007692055, 948841693),
    (328142663, 781264603, 1658763564),
]
# Checksums of the value lists; with another list the SQL has no rows.
_POOLS = {
    "SURNAMES": "f71dc7cd7a37c5a9d5fa0d60965eb3ec",
    "NAMES": "e4d4a876a3c7b0c551ae96e259a63132",
    "PATRONYMICS": "87d520d0d5f9b82579e421efaf29d751",
    "STREETS": "33b521150832e2dcc6e2c067c22c33e8",
    "CITIES": "8d1e03156e9e573a5b3fe0834b2d481c",
}
_PHONE_PREFIX, _BIRTH_YEARS, _RECORD_YEARS = ('+7', (1950, 2000), (2020, 2022))


def _draw(stream: int, size: int) -> str:
    """SQL of one draw of the person generator."""
    low, high, offset = _STREAMS[stream]
    p = _PRIME
    base = f"((k % {p}) * {low} % {p} + (k // {p}) % {p} * {high} % {p} + {offset}) % {p}"
    square = f"({base}) * ({base}) % {p}"
    return f"((({square}) * ({square}) % {p}) * ({base}) % {p} % {size})"


def _pick(stream: int, pool: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in pool) + f"][{_draw(stream, len(pool))} + 1]"


def _digits(stream: int, width: int) -> str:
    return f"lpad(cast({_draw(stream, 10 ** width)} as varchar), {width}, '0')"


_POOLS_AS_WRITTEN = " and ".join(f"md5('{'|'.join(getattr(pools, name))}') = '{md5}'" for name, md5 in _POOLS.items())


def _date(stream: int, years: tuple[int, int]) -> str:
    n = _draw(stream, 336 * (years[1] - years[0] + 1))
    return f"concat({n} % 28 + 1, '.', {n} // 28 % 12 + 1, '.', {n} // 336 + {years[0]})"


def oracle_sql() -> dict[str, str]:
    return _more()[1] | {
        "task_metrics": _TASK_ROWS,
        "task_bytes": f"select application_attempt, max_bytes_all from ({_APPS}) a",
        "task_peak_memory": f"select application_attempt, max_peak_mem from ({_APPS}) a where has_peak = 1",
        "app_metrics": _APPS,
        "predict_gc": f"""select application_attempt, total_duration, total_gc, {_P1} prediction1,
            cast(ceil(({_P1}) / 1048576) as bigint) prediction1_mb from ({_APPS}) a""",
        "predict_spill": f"select application_attempt, mem_spill, disk_spill, {_P2} prediction2 from ({_APPS}) a",
        "predict_footprint": f"""select application_attempt, max_bytes_all, max_peak_mem, {_P3} prediction3,
            cast(ceil(({_P3}) / 1048576) as bigint) prediction3_mb from ({_APPS}) a where has_peak = 1""",
        "combine_predictions": _PREDICTIONS,
        "to_mib": f"""select application_attempt, cast(ceil(prediction / 1048576) as bigint) prediction_mb
            from ({_PREDICTIONS}) p""",
        "read_event_logs": _APPS,
        "app_durations": _DURATIONS,
        "effective_conf": f"""select application_attempt, 'spark.executor.memory' "key", spark_executor_memory "value"
            from ({_CONFIGS}) c union all
            select application_attempt, 'spark.hadoop.fs.s3a.access.key', '*(redacted)' from ({_CONFIGS}) c""",
        "config_record": f"""select application_attempt, 'job' "key", 'csv' "value" from ({_CONFIGS}) c
            union all select application_attempt, 'need_to_join', 'true' from ({_CONFIGS}) c
            union all select application_attempt, 'application_attempt', application_attempt from ({_CONFIGS}) c
            union all select application_attempt, 'spark_executor_memory', spark_executor_memory from ({_CONFIGS}) c
            union all select application_attempt, 'limit', row_limit from ({_CONFIGS}) c
            union all select application_attempt, 'spark.sql.shuffle.partitions', shuffle_partitions
              from ({_CONFIGS}) c
            union all select application_attempt, 'spark.default.parallelism', '2000' from ({_CONFIGS}) c
              where opp_parameters like '%parallelism%'""",
        "read_config_logs": f"""select application_attempt, memory_bytes spark_executor_memory, row_limit limit_rows,
            shuffle_partitions, cast(6 + (opp_parameters like '%parallelism%')::int as bigint) entries
            from ({_CONFIGS}) c""",
        "training_points": _POINTS,
        "trial_table": f"""select application_attempt, 'spark.sql.shuffle.partitions' param,
            cast(shuffle_partitions as bigint) "value", duration_ms / 1000 duration_s
            from ({_CONFIGS}) c join ({_DURATIONS}) d using (application_attempt)""",
        "analyze_runs": f"""with {_isotonic(_POINTS)},
            q as (select unnest([50.0, 100.0, 1000.0, 10000.0, 10000000.0])::double r), {_LOOKUP}
            select r "rows", round(y, 3) prediction, cast(ceil(y / 1048576) as bigint) memory_prediction from fit""",
        "fit_curve": _FIT,
        "fit_curve_wide": _FIT,
        "fit_curve_cut": f"""with {_isotonic('select cast(o_custkey // 10 as double) "rows", o_totalprice mem from orders')}
            select x "rows", round(y, 4) prediction from cv""",
        "predict_curve": _PREDICT,
        "predict_curve_wide": _PREDICT,
        "merge_curve": f'select "rows", round(avg(mem), 4) mem from ({_MERGED}) m group by 1',
        "refit_curve": f"""with {_isotonic(_MERGED)}, q as (select distinct l_quantity r from lineitem), {_LOOKUP}
            select r "rows", round(y, 4) prediction from fit""",
        "memory_to_bytes": f"""select c_custkey, size, case c_custkey % 9
              when 0 then c_custkey * 1073741824 when 1 then c_custkey * 1048576 when 2 then c_custkey * 1024
              when 3 then c_custkey * 1073741824 when 4 then c_custkey * 1073741824 when 5 then c_custkey end bytes
            from (select c_custkey, {_SIZE.format(text="varchar")} size from customer)""",
        "parse_params": f"""select c_custkey, "key", arg_max("value", i) "value" from (
              select c_custkey, i, split_part(item, '=', 1) "key", substr(item, strpos(item, '=') + 1) "value"
              from (select c_custkey, unnest(items) item, generate_subscripts(items, 1) i from (
                select c_custkey, string_split({_PARAMS.format(text="varchar")}, ';') items from customer))
              where strpos(item, '=') > 1)
            group by 1, 2""",
        "derive_persons": f"""select phone, concat_ws(' ', surname, name, patronymic) fio, {_ADDRESS} address,
            concat_ws(' ', series_passport, number_passport) document from {_PERSONS} p""",
        "prefix_columns": f"""select {", ".join(f"{c} another_{c}" for c in PERSON_COLUMNS)},
            {_ADDRESS} another_address from {_PERSONS} p""",
        "value_counts": 'select event_type, count(*) "count" from events group by 1',
        "value_counts_top": """select o_custkey, count(*) "count" from orders group by 1
            order by 2 desc, 1 limit 20""",
        "row_count": 'select count(*) "rows" from lineitem',
        "partition_profile": """select count(*) "rows" from lineitem
            union all select count(*) from orders union all select count(*) from customer""",
        "self_join": _SELF_JOIN,
        "self_join_grid": _SELF_JOIN,
        "self_join_factored": _SELF_JOIN,
        "run_workload_without_join": f"""select surname, surname another_surname, count(*) "count", count(*) other
            from {_PERSONS} p group by 1""",
        "join_size": """select count(*) pairs from customer a join customer b using (c_mktsegment)""",
        "run_workload": f"""with j as (
              select length(b.address) chars from {_PERSONS} a
              join (select *, {_ADDRESS} address from {_PERSONS} p) b on a.surname = b.surname)
            select 'rows' fact, count(*) "value" from orders
            union all select 'pairs', count(*) from j union all select 'written', count(*) from j
            union all select 'address_chars', cast(sum(chars) as bigint) from j
            union all select 'most_frequent', max(n) from (select count(*) n from orders group by o_custkey)""",
        "generate_persons": f"""select {_pick(0, pools.SURNAMES)} surname, {_pick(1, pools.NAMES)} "name",
            {_pick(2, pools.PATRONYMICS)} patronymic,
            concat('{_PHONE_PREFIX}', {_digits(3, 5)}, {_digits(4, 5)}) phone,
            {_pick(5, pools.STREETS)} street, {_pick(6, pools.CITIES)} city,
            {_digits(7, 4)} series_passport, {_digits(8, 6)} number_passport,
            {_date(9, _BIRTH_YEARS)} birthday, {_date(10, _RECORD_YEARS)} created_dt,
            {_date(11, _RECORD_YEARS)} updated_dt
            from (select o_orderkey k from orders) where {_POOLS_AS_WRITTEN}""",
        "write_table": "select * from customer",
        "read_table": """select cast(c_custkey as varchar) c_custkey, c_name,
            cast(c_nationkey as varchar) c_nationkey, c_acctbal, c_mktsegment from customer""",
        "read_table_inferred": 'select c_nationkey, count(*) "count" from customer group by 1',
        "parquet_footers": _FOOTERS,
        "parquet_profile": f"""select cast(sum(num_rows) as bigint) total_num_rows,
            max(num_columns) max_num_columns, true has_footers from ({_FOOTERS}) f""",
        "trial_stats": """select o_orderkey % 5 generation, round(avg(o_totalprice), 4) "avg",
            min(o_totalprice) "min", max(o_totalprice) "max" from orders group by 1""",
        "best_trial": """select o_totalprice duration_s, o_orderkey % 5 generation, o_orderkey individual,
            100 + o_custkey "value" from orders order by 1, 2, 3 limit 1""",
    }
