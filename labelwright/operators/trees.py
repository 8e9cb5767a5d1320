"""Exact shallow decision trees of all folds at once, from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import ratio
from ..session import pin
from .conditions import column_roles
from .ordered import grouped_median, running_totals
from .splits import stratified_folds

#: What a split says: its place among the columns, the value or threshold, and rows and positives of the side that meets it and of the node.
_SPLIT = "struct<impurity:double,c:int,v:string,x:double,n:bigint,p:bigint,all_n:bigint,all_p:bigint>"


def _impurity(n: Column, p: Column, all_n: Column, all_p: Column) -> Column:
    """Rows times Gini impurity of both sides of a split."""
    n, p, m, q = (c.cast("double") for c in (n, p, all_n - n, all_p - p))
    return 2 * p * (n - p) / n + 2 * q * (m - q) / m


def _best_splits(cells: DataFrame, **limits: int) -> DataFrame:
    """(f, node, s): the best split of every node of every fold's tree; none for a node of one class or of equal rows.

    ``cells`` (f, node, c, v, x, n, p) count the rows and positives of each value, text in v or number in x, of each column c.
    A text column splits into one value and the rest, a number at the middle between neighbours. Of equally good splits the earlier column's,
    then the smaller value's is taken.
    """
    by = ["f", "node", "c"]
    texts = cells.filter(F.col("v").isNotNull())
    totals = texts.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    one = texts.join(totals, by).select(*by, "v", F.lit(None).cast("double").alias("x"), "n", "p", "all_n", "all_p")
    numbers = cells.filter(F.col("x").isNotNull()).select(*by, "x", "n", "p")
    placed = running_totals(numbers, by, "x", ["n", "p"], **limits)
    below = placed.select(*by, F.lit(None).cast("string").alias("v"), "x", F.col("cum_n").alias("n"), F.col("cum_p").alias("p"), "all_n", "all_p")
    splits = one.unionByName(below).filter("n < all_n AND all_p > 0 AND all_p < all_n")
    scored = splits.withColumn("impurity", _impurity(F.col("n"), F.col("p"), F.col("all_n"), F.col("all_p")))
    best = pin(scored.groupBy("f", "node").agg(F.min(F.struct("impurity", "c", "v", "x", "n", "p", "all_n", "all_p")).alias("s")))
    # a threshold lies midway to the next number of the same rows; one row per node
    cut = best.filter("s.x IS NOT NULL").select("f", "node", F.col("s.c").alias("c"), F.col("s.x").alias("at"))
    after = numbers.join(F.broadcast(cut), by).filter("x > at").groupBy("f", "node").agg(F.min("x").alias("next"))
    middle = F.when(F.col("next").isNotNull(), (F.col("s.x") + F.col("next")) / 2)
    return best.join(after, ["f", "node"], "left").select("f", "node", F.col("s").withField("x", middle).cast(_SPLIT).alias("s"))


def fit_trees(rows: DataFrame, texts: Sequence[str], numbers: Sequence[str], k: int, depth: int, *, weight: str | None = None,
              **limits: int) -> dict[tuple[int, int], dict]:
    """The splits of ``k`` trees, tree f fitted on the rows of all folds but f: {(f, node): split}. Nodes are 1, then 2i and 2i + 1.

    ``rows`` (fold, y, ``texts``, ``numbers``; no nulls), each standing for ``weight`` rows, are read once per level: the rows of a value count
    once for all trees, by their fold and the node that each tree puts them in, and only these counts are dealt out to the trees.
    """
    columns = [*numbers, *texts]
    trees: dict[tuple[int, int], dict] = {}
    copies = F.col(weight) if weight else F.lit(1).cast("bigint")
    for level in range(depth):
        at = F.array(*[node_of(f, trees, columns, level) for f in range(k)])
        placed = rows.select("fold", "y", copies.alias("_n"), at.alias("at"), *columns)
        parts = []
        for names, kind in ((texts, "v"), (numbers, "x")):
            if names:
                long = placed.select("fold", "y", "_n", "at", *names).unpivot(["fold", "y", "_n", "at"], list(names), "c", "value")
                parts.append(long.select("fold", "y", "_n", "at", "c", (F.col("value") if kind == "v" else F.lit(None)).cast("string").alias("v"),
                                         (F.col("value") if kind == "x" else F.lit(None)).cast("double").alias("x")))
        long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("c")).cast("int")
        counts = pin(long.groupBy("fold", "at", "c", "v", "x").agg(
            F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("y")).alias("p")).withColumn("c", place))
        dealt = counts.select("fold", F.posexplode("at").alias("f", "node"), "c", "v", "x", "n", "p").filter("f != fold")
        cells = pin(dealt.groupBy("f", "node", "c", "v", "x").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))
        found = {(r["f"], r["node"]): r["s"].asDict() for r in _best_splits(cells, **limits).collect()}  # k times 2^level at most
        if not found:
            break
        trees |= found
    return trees


def _met(split: dict, columns: Sequence[str]) -> Column:
    value = F.col(columns[split["c"] - 1])
    return value == split["v"] if split["v"] is not None else value <= split["x"]


def node_of(f: int, trees: dict, columns: Sequence[str], depth: int, node: int = 1) -> Column:
    """The node that tree ``f`` puts a row in, ``depth`` levels down; a node without a split keeps its rows."""
    split = trees.get((f, node))
    if depth == 0 or split is None:
        return F.lit(node)
    return F.when(_met(split, columns), node_of(f, trees, columns, depth - 1, 2 * node + 1)).otherwise(
        node_of(f, trees, columns, depth - 1, 2 * node))


def _answer(f: int, trees: dict, columns: Sequence[str], default: int, node: int = 1) -> Column:
    """The majority of the leaf that tree ``f`` puts a row in; ties are 0."""
    split = trees.get((f, node))
    if split is None:
        return F.lit(default)
    hit = int(2 * split["p"] > split["n"])
    miss = int(2 * (split["all_p"] - split["p"]) > split["all_n"] - split["n"])
    return F.when(_met(split, columns), _answer(f, trees, columns, hit, 2 * node + 1)).otherwise(
        _answer(f, trees, columns, miss, 2 * node))


def filled_columns(df: DataFrame, texts: Sequence[str], numbers: Sequence[str], missing: str, weight: str | None = None) -> list[Column]:
    """Text and number columns without nulls: missing numbers (null and NaN) are the median of the table, whose rows count ``weight``
    times, 0 where there is none."""
    middle = grouped_median(df, [], list(numbers), weight=weight).first() if numbers else None
    out = [F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in texts]
    for c in numbers:
        value = F.col(c).cast("double")
        fill = middle[c] if middle and middle[c] is not None else 0.0
        out.append(F.coalesce(F.when(~F.isnan(value), value), F.lit(fill)).alias(c))
    return out


def tree_cv(df: DataFrame, target: str, keys: Sequence[str], *, depth: int = 2, k: int = 5, seed: int = 0, missing: str = "nan",
            **limits: int) -> DataFrame:
    """Cross-validated accuracy of a shallow tree on all input columns (``keys`` are not inputs): depth, folds, acc_mean, acc_min.

    The tree is exact: every value of a text column and every gap between two numbers is tried, by Gini impurity, level
    by level. Folds are stratified and seeded. An empty table has no folds. Rows that are equal in fold, target and inputs are
    one row with a count from here on.
    """
    texts, numbers = column_roles(df.drop(*keys), target)
    folded = stratified_folds(df, target, keys, k, 1, seed)
    columns = [*numbers, *texts]
    cells = pin(folded.groupBy(F.col("fold_0").alias("_fold"), F.col(target).cast("bigint").alias("_y"), *columns).agg(F.count("*").alias("_n")))
    rows = pin(cells.select(F.col("_fold").alias("fold"), F.col("_y").alias("y"), "_n",
                            *filled_columns(cells, texts, numbers, missing, "_n")))
    trees = fit_trees(rows, texts, numbers, k, depth, weight="_n", **limits)
    sizes = {r["fold"]: (r["n"], r["p"]) for r in rows.groupBy("fold").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("y")).alias("p")).collect()}
    n, p = (sum(s[i] for s in sizes.values()) for i in (0, 1))
    answers = [_answer(f, trees, columns, int(2 * (p - sizes.get(f, (0, 0))[1]) > n - sizes.get(f, (0, 0))[0])) for f in range(k)]
    told = rows.select("fold", "y", "_n", F.get(F.array(*answers), "fold").alias("pred"))
    right = F.coalesce(F.sum(F.when(F.col("y") == F.col("pred"), F.col("_n"))), F.lit(0))
    per_fold = told.groupBy("fold").agg(ratio(right, F.sum("_n")).alias("acc"))
    return per_fold.agg(F.lit(depth).alias("depth"), F.count("*").alias("folds"), F.avg("acc").alias("acc_mean"), F.min("acc").alias("acc_min"))
