"""Read-only SQL over named DataFrames: one query, named relations and known functions only, a row cap and a time limit.

The text is parsed by Spark and its plan is checked before anything is analysed
or run: each node must be one of PLANS, each relation one of the given tables or a
name of the query's own WITH, each function one of FUNCTIONS. So commands, files
as tables, table functions, reflection and functions of the session are out,
while words in literals don't matter.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Nodes of a parsed query.
PLANS = set(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith"
    " UnresolvedHaving WithWindowDefinition Union Intersect Except UnresolvedRelation OneRowRelation UnresolvedInlineTable Pivot Unpivot".split()
)
#: Functions that read nothing but their arguments.
FUNCTIONS = set(
    "abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_size ascii asin atan avg bool_and"
    " bool_or bround cardinality ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop cume_dist"
    " current_date date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exp explode"
    " extract first first_value floor format_number from_unixtime get greatest hour if ifnull initcap instr isnotnull isnull lag last last_day last_value lead least left"
    " length ln locate log log10 log2 lower lpad ltrim make_date map max max_by md5 mean median min min_by minute mod mode month months_between named_struct nth_value ntile"
    " nullif nvl nvl2 percent_rank percentile percentile_approx pmod position pow power quarter rank regexp_count regexp_extract regexp_like regexp_replace repeat replace"
    " reverse right round row_number rpad rtrim sequence sha1 sha2 sign size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop"
    " stddev_samp string struct substr substring substring_index sum to_date to_timestamp translate trim trunc try_add try_cast try_divide try_subtract try_to_date"
    " try_to_number try_to_timestamp typeof unix_timestamp upper var_pop var_samp variance weekday weekofyear when year".split()
)


class Rejected(ValueError):
    """The text isn't a single read-only query over the given tables."""


def _each(items: JavaObject) -> Iterator[JavaObject]:
    for k in range(items.size()):
        yield items.apply(k)


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(e: JavaObject, names: set[str]) -> None:
    if _kind(e) == "UnresolvedFunction":
        function = ".".join(_each(e.nameParts()))
        if function.lower() not in FUNCTIONS:
            raise Rejected(f"function {function} is not allowed")
    elif _kind(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _check_plan(e.plan(), names)
    elif "Subquery" in _kind(e) and _kind(e) != "InSubquery":
        raise Rejected(f"{_kind(e)} is not allowed")
    for x in _each(e.children()):
        _check_expression(x, names)


def _check_plan(p: JavaObject, names: set[str]) -> None:
    kind = _kind(p)
    if kind not in PLANS:
        raise Rejected(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        relation = [x.lower() for x in _each(p.multipartIdentifier())]
        if len(relation) != 1 or relation[0] not in names:
            raise Rejected(f"table {'.'.join(relation)} is not known")
    if kind == "UnresolvedWith":
        for cte in _each(p.cteRelations()):
            # a name holds from its own definition on; inside itself it would be a recursion, which is not allowed
            _check_plan(cte._2(), names)
            names = names | {cte._1().lower()}
    for e in _each(p.expressions()):
        _check_expression(e, names)
    for x in _each(p.children()):
        _check_plan(x, names)


def checked(spark: SparkSession, sql: str, tables: list[str]) -> str:
    """The query itself, if it reads nothing but tables."""
    text = (sql or "").strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JJavaError) as e:
        raise Rejected(str(e).splitlines()[0]) from e
    _check_plan(plan, {t.lower() for t in tables})
    return text


def lazily(spark: SparkSession, sql: str, limit: int = 500, **tables: DataFrame) -> DataFrame:
    """At most limit rows of sql, whose table names are the keys of tables; not run yet."""
    text = checked(spark, sql, list(tables))
    mark = f"guard_{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{mark}_{name}")
    try:
        # the tables are names of an outer WITH, so that no view of the session shows under them
        own = ", ".join(f"`{name}` AS (SELECT * FROM {mark}_{name})" for name in tables)
        return spark.sql((f"WITH {own} " if own else "") + f"SELECT * FROM (\n{text}\n) LIMIT {int(limit)}")
    finally:
        for name in tables:
            spark.catalog.dropTempView(f"{mark}_{name}")


def collect_within(df: DataFrame, seconds: float) -> list:
    """Rows of df; from so many seconds on its jobs are cancelled, as often as it starts one, and TimeoutError is raised."""
    spark = df.sparkSession
    tag = f"guard-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.1):
                spark.interruptTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.addTag(tag)
    watcher.start()
    try:
        rows = df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds} seconds") from e
        raise
    finally:
        done.set()
        watcher.join()
        spark.removeTag(tag)
    if late.is_set():
        raise TimeoutError(f"not done within {seconds} seconds")
    return rows


def run(spark: SparkSession, sql: str, limit: int = 500, seconds: float = 60.0, **tables: DataFrame) -> DataFrame:
    """At most limit rows of sql, read within so many seconds."""
    df = lazily(spark, sql, limit, **tables)
    return spark.createDataFrame(collect_within(df, seconds), df.schema)
