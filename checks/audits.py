"""Label audit: single conditions, stumps, the greedy rule and the negative control."""

from __future__ import annotations


from labelwright.operators import conditions as cond
from labelwright.operators.trees import tree_cv
from labelwright.plans.label_audit import audit_report

from . import views as v
from .registry import check, with_ctes

SUPPORT = 20


def _categorical_sql(table: str, columns: list[str], whole: tuple[str, ...] = ()) -> str:
    """``found`` CTE: every (column, value) with its counts; few-valued numbers included."""
    parts = []
    for c in columns:
        text = f"CAST({c} AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS \"column\", {text} AS value, count(*) AS n_rows, sum(target)::BIGINT AS positives "
                     f"FROM {table} GROUP BY 2")
    return f"found AS ({' UNION ALL '.join(parts)})"


_PURITY = """round(greatest(positives,n_rows-positives)/n_rows,6) AS purity,
  CASE WHEN positives=n_rows THEN 1::BIGINT WHEN positives=0 THEN 0::BIGINT END AS pure_label"""
FEW = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "o_orderstatus", "o_orderpriority"]


@check("audit_categorical", with_ctes(f"""SELECT "column", value, n_rows, positives, {_PURITY} FROM found WHERE n_rows>={SUPPORT}""",
                                      v.AUDIT, _categorical_sql("audit", FEW)))
def audit_categorical(spark, sf):
    found = cond.categorical_conditions(v.audit_table(spark, sf), "target", v.AUDIT_COLUMNS)
    return found.select("column", "value", "n_rows", "positives", "purity", "pure_label")


def stump_sql(table: str, column: str, name: str = "stump_rows") -> str:
    """CTE with the two sides of the best split of one numeric column."""
    return f"""{name}_d AS (SELECT CAST({column} AS DOUBLE) AS x, count(*) AS n, sum(target)::BIGINT AS p FROM {table}
  WHERE {column} IS NOT NULL GROUP BY 1),
 {name}_c AS (SELECT x, CAST(sum(n) OVER w AS DOUBLE) AS n, CAST(sum(p) OVER w AS DOUBLE) AS p, lead(x) OVER (ORDER BY x) AS nxt,
  CAST(sum(n) OVER () AS DOUBLE) AS tn, CAST(sum(p) OVER () AS DOUBLE) AS tp FROM {name}_d
  WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
 {name}_b AS (SELECT * FROM {name}_c WHERE nxt IS NOT NULL AND tp>0 AND tp<tn
  ORDER BY 2*p*(n-p)/n + 2*(tp-p)*((tn-n)-(tp-p))/(tn-n), x LIMIT 1),
 {name} AS (SELECT '{column}' AS "column", '<=' AS op, (x+nxt)/2 AS threshold, n::BIGINT AS n_rows, p::BIGINT AS positives FROM {name}_b
  UNION ALL SELECT '{column}', '>', (x+nxt)/2, (tn-n)::BIGINT, (tp-p)::BIGINT FROM {name}_b)"""


@check("audit_stump", with_ctes(f"""SELECT "column", op, round(threshold,6) AS threshold, n_rows, positives, {_PURITY}
  FROM stump_rows WHERE n_rows>={SUPPORT}""", v.STUMP, stump_sql("stump", "l_quantity")))
def audit_stump(spark, sf):
    # small limits: the same split through the many-range path
    found = cond.stump_conditions(v.stump_table(spark, sf), "target", small=10, range_cells=20)
    return found.select("column", "op", "threshold", "n_rows", "positives", "purity", "pure_label")


def _conditions_sql(table: str, few: list[str]) -> str:
    return f"""all_found AS (SELECT "column", '==' AS op, value, CAST(NULL AS DOUBLE) AS threshold, n_rows, positives FROM found
  UNION ALL SELECT "column", op, NULL, threshold, n_rows, positives FROM stump_rows),
 kept AS (SELECT *, {_PURITY} FROM all_found WHERE n_rows>={SUPPORT})"""


@check("audit_conditions", with_ctes("""SELECT "column", op, value, round(threshold,6) AS threshold, n_rows, positives, purity,
  pure_label FROM kept""", v.AUDIT, _categorical_sql("audit", FEW), stump_sql("audit", "l_quantity"), _conditions_sql("audit", FEW)))
def audit_conditions(spark, sf):
    return cond.single_conditions(v.audit_table(spark, sf), "target", v.AUDIT_COLUMNS)


_RULE = """SELECT 'l_returnflag == "R" OR o_orderpriority == "1-URGENT"' AS rule, 2::BIGINT AS n_conditions, 1.0::DOUBLE AS accuracy,
  count(*) FILTER (CAST(l_returnflag='R' OR o_orderpriority='1-URGENT' AS INT) <> target) AS mismatches,
  sum(target)::BIGINT AS positives_covered, sum(target)::BIGINT AS positives_total FROM audit"""


@check("greedy_rule", with_ctes(_RULE, v.AUDIT))
def greedy_rule(spark, sf):
    table = v.audit_table(spark, sf)
    found = cond.single_conditions(table, "target", v.AUDIT_COLUMNS)
    return cond.greedy_or_rule(table, "target", found, v.AUDIT_COLUMNS)


@check("audit_report", with_ctes(f"""
SELECT 'target' AS target, (SELECT count(*) FROM audit) AS n, (SELECT sum(target)::BIGINT FROM audit) AS positives,
  (SELECT round(avg(target),6) FROM audit) AS rate, (SELECT count(pure_label) FROM kept) AS pure_conditions,
  (SELECT count(*) FILTER (pure_label=1) FROM kept) AS pure_positive_conditions, r.* FROM ({_RULE}) r""",
                                 v.AUDIT, _categorical_sql("audit", FEW), stump_sql("audit", "l_quantity"),
                                 _conditions_sql("audit", FEW)))
def report(spark, sf):
    return audit_report(v.audit_table(spark, sf), "target", v.AUDIT_COLUMNS, materialize=True)


_NEG_FEW = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]


@check("audit_negative", with_ctes("""
SELECT 'target' AS target, (SELECT count(*) FROM negative) AS n, (SELECT sum(target)::BIGINT FROM negative) AS positives,
  (SELECT round(avg(target),6) FROM negative) AS rate, (SELECT count(pure_label) FROM kept) AS pure_conditions,
  (SELECT count(*) FILTER (pure_label=1) FROM kept) AS pure_positive_conditions, CAST(NULL AS VARCHAR) AS rule,
  0::BIGINT AS n_conditions, (SELECT round(avg(CAST(target=0 AS INT)),6) FROM negative) AS accuracy,
  (SELECT sum(target)::BIGINT FROM negative) AS mismatches, 0::BIGINT AS positives_covered,
  (SELECT sum(target)::BIGINT FROM negative) AS positives_total""",
                                   v.NEGATIVE, _categorical_sql("negative", _NEG_FEW), stump_sql("negative", "l_quantity"),
                                   _conditions_sql("negative", _NEG_FEW)))
def negative(spark, sf):
    return audit_report(v.negative_table(spark, sf), "target", v.NEGATIVE_COLUMNS)


def _tree_sql(base: str, texts: list[str], numbers: list[str], depth: int = 2, k: int = 5) -> str:
    """A tree for each fold, level by level; ``base`` is a table (id, fold, y, columns)."""
    columns = [*numbers, *texts]
    long = " UNION ALL ".join(
        f"SELECT id, {i + 1} AS c, {f'{c} AS v, NULL::DOUBLE AS x' if c in texts else f'NULL::VARCHAR AS v, CAST({c} AS DOUBLE) AS x'} FROM {base}"
        for i, c in enumerate(columns))
    steps = [f"long AS MATERIALIZED ({long})",
             f"node0 AS MATERIALIZED (SELECT f, id, y, fold <> f AS fit, 1 AS node FROM {base}, range({k}) t(f))"]
    for d in range(depth):
        steps += [f"""tot{d} AS (SELECT f, node, count(*) AS tn, sum(y)::BIGINT AS tp FROM node{d} WHERE fit GROUP BY ALL)""",
                  f"""cell{d} AS (SELECT f, node, c, v, x, count(*) AS n, sum(y)::BIGINT AS p FROM node{d} JOIN long USING (id) WHERE fit GROUP BY ALL)""",
                  f"""run{d} AS (SELECT f, node, c, v, x, n, p, CAST(NULL AS DOUBLE) AS nxt FROM cell{d} WHERE v IS NOT NULL UNION ALL
  SELECT f, node, c, v, x, sum(n) OVER w, sum(p) OVER w, lead(x) OVER (PARTITION BY f, node, c ORDER BY x) FROM cell{d} WHERE x IS NOT NULL
  WINDOW w AS (PARTITION BY f, node, c ORDER BY x ROWS UNBOUNDED PRECEDING))""",
                  f"""best{d} AS MATERIALIZED (SELECT f, node, c, v, (x + nxt) / 2 AS x FROM
  (SELECT *, n::DOUBLE AS a, p::DOUBLE AS b, (tn - n)::DOUBLE AS m, (tp - p)::DOUBLE AS q FROM run{d} JOIN tot{d} USING (f, node) WHERE n < tn AND tp > 0 AND tp < tn)
  QUALIFY row_number() OVER (PARTITION BY f, node ORDER BY 2*b*(a-b)/a + 2*q*(m-q)/m, c, v NULLS FIRST, run{d}.x NULLS FIRST) = 1)"""
                  .replace("run" + str(d) + ".x NULLS", "x NULLS"),
                  f"""node{d + 1} AS MATERIALIZED (SELECT f, id, y, fit, CASE WHEN b.c IS NULL THEN node WHEN coalesce(l.v = b.v, l.x <= b.x) THEN 2 * node + 1
  ELSE 2 * node END AS node FROM node{d} LEFT JOIN best{d} b USING (f, node) LEFT JOIN long l USING (id, c))"""]
    return ", ".join(steps) + f""", leaf AS (SELECT f, node, CAST(2 * sum(y) > count(*) AS INT) AS pred FROM node{depth} WHERE fit GROUP BY ALL),
 acc AS (SELECT f, avg(CAST(y = pred AS INT)) AS acc FROM node{depth} JOIN leaf USING (f, node) WHERE NOT fit GROUP BY 1)"""


_TREE = "SELECT 2::BIGINT AS depth, count(*) AS folds, round(avg(acc),6) AS acc_mean, round(min(acc),6) AS acc_min FROM acc"
_RECORD_TEXTS = [f for f in v.RECORDS.fields]
_RECORD_BASE = f"""base AS (SELECT row_id AS id, gold AS y, (row_number() OVER (PARTITION BY gold ORDER BY md5('0.0|' || row_id)) - 1) % 5 AS fold,
  {', '.join(f"coalesce({f}, 'nan') AS {f}" for f in _RECORD_TEXTS)} FROM records)"""


@check("tree_cv", with_ctes(_TREE, v.RECORDS_SQL, _RECORD_BASE, _tree_sql("base", _RECORD_TEXTS, [])))
def cross_validated_tree(spark, sf):
    return tree_cv(v.records_table(spark, sf), "gold", ["row_id"])


_LINE_TEXTS, _LINE_NUMBERS = ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_TARGET = "CAST((l_extendedprice > 30000 AND l_returnflag <> 'A') OR (l_orderkey * 7 + l_partkey) % 11 = 0 AS INT)"
_LINE_BASE = f"""base AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('0.0|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey
  || '|' || l_suppkey)) - 1) % 5 AS fold FROM (SELECT row_number() OVER () AS id, *, {_LINE_TARGET} AS y FROM lineitem))"""


@check("tree_cv_numbers", with_ctes(_TREE, _LINE_BASE, _tree_sql("base", _LINE_TEXTS, _LINE_NUMBERS)))
def cross_validated_tree_on_numbers(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = v.read(spark, sf, "lineitem").selectExpr(*keys, *_LINE_NUMBERS, *_LINE_TEXTS, f"{_LINE_TARGET} AS target")
    return tree_cv(rows, "target", keys)
