"""Simple baseline models on Spark ML: encode, fit, score, cross-validate.

Category slots and medians are learnt from the training rows only, in one pass each; the
long prediction table of all models is then measured in one grouped pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checkout as co
from ..functions.joins import join_groups
from ..session import pin
from ..vocab import Vocabulary
from .classification import classification_metrics
from .ordered import grouped_median, running_totals
from .ranking import auroc
from .rule_tables import apply_rule
from .scoring import model_scores
from .splits import stratified_folds

#: Models fitted at a time, and folds of a cross-validation, each with as many models.
FITS, FOLDS = 4, 3
#: How many rows a distinct training row stands for, and training rows of a task.
COPIES, FIT_ROWS = "_copies", 20_000


@dataclass(frozen=True)
class ModelSpec:
    """One model: which estimator, on which columns."""

    name: str
    kind: str  # tree | logistic | boosting
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Encoding:
    """What was learnt from the training rows about the input columns.

    ``levels`` is a table (column, value, slot): frequent values have slots of their own in the order of
    their texts, rare ones share the slot behind these. ``slots`` counts the slots of a column.
    """

    medians: dict[str, float]
    levels: DataFrame | None
    slots: dict[str, int]
    rows: int


def learn_encoding(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, missing: str = "None",
                   min_count: int = 1, impute: bool = True, weight: str | None = None) -> Encoding:
    """Medians and category slots (values below ``min_count`` rows are rare), for columns of any width. A row stands for ``weight`` rows."""
    levels, slots = None, dict.fromkeys(categorical, 0)
    copies = F.col(weight) if weight else F.lit(1).cast("bigint")
    if categorical:
        wide = train.select(copies.alias("_n"), *[category(c, missing).alias(c) for c in categorical])
        counts = pin(wide.unpivot(["_n"], list(categorical), "column", "value").groupBy("column", "value").agg(
            F.sum("_n").alias("n")))
        often = counts.filter(F.col("n") >= min_count).withColumn("_one", F.lit(1).cast("bigint"))
        placed = running_totals(often, ["column"], "value", ["_one"]).select(
            "column", "value", (F.col("cum__one") - 1).alias("slot"))
        sizes = counts.groupBy("column").agg(F.count_if(F.col("n") >= min_count).alias("often"), F.count_if(F.col("n") < min_count).alias("rare"))
        shared = counts.filter(F.col("n") < min_count).join(sizes, "column").select("column", "value", F.col("often").alias("slot"))
        levels = pin(placed.unionByName(shared))
        slots |= {r["column"]: r["often"] + (r["rare"] > 0) for r in sizes.collect()}  # one row per column
    medians: dict[str, float] = {}
    if numeric and impute:
        middle = grouped_median(train, [], list(numeric), weight=weight).first()
        medians = {c: (middle[c] if middle and middle[c] is not None else 0.0) for c in numeric}
    return Encoding(medians, levels, slots, train.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0])


def category(name: str, missing: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def prepare(df: DataFrame, enc: Encoding, numeric: Sequence[str], categorical: Sequence[str],
            missing: str = "None") -> DataFrame:
    """Fill numbers with the training medians (``num_<c>``); look up the slot of each category (``ix_<c>``).

    A category that was not seen in training takes the slot behind all others.
    """
    cells = {}
    for c in numeric:
        value = F.col(c).cast("double")
        cells[f"num_{c}"] = F.coalesce(F.when(~F.isnan(value), value), F.lit(enc.medians.get(c, 0.0)))
    out = df.withColumns(cells) if cells else df
    for c in categorical:
        known = enc.levels.filter(F.col("column") == c).select(F.col("value").alias(f"_is_{c}"), F.col("slot").alias(f"_at_{c}"))
        slot = F.coalesce(F.col(f"_at_{c}"), F.lit(enc.slots[c])).cast("double")
        nominal = {"ml_attr": {"type": "nominal", "num_vals": enc.slots[c] + 1, "name": f"ix_{c}"}}
        out = out.join(known, category(c, missing) == F.col(f"_is_{c}"), "left").withColumn(
            f"ix_{c}", slot.alias(f"ix_{c}", metadata=nominal)).drop(f"_is_{c}", f"_at_{c}")
    return out


def distinct_rows(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """The distinct rows of ``columns`` and ``COPIES``, how many rows (or how much of ``weight``) each stands for."""
    return df.groupBy(*columns).agg((F.sum(weight) if weight else F.count("*")).alias(COPIES))


def column_scales(cells: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of the rows that ``cells`` stand for."""
    w = F.col(COPIES).cast("double")
    sums = cells.agg(F.sum(w).alias("_n"), *[F.sum(w * F.col(c)).alias(c) for c in columns]).first()
    n = sums["_n"] or 0.0
    means = {c: sums[c] / n if n else 0.0 for c in columns}
    squares = cells.agg(F.lit(0), *[F.sum(w * (F.col(c) - means[c]) ** 2).alias(c) for c in columns]).first()
    return {c: (means[c], (squares[c] / (n - 1)) ** 0.5 if n > 1 else 0.0) for c in columns}


def standardized(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns less their mean, over their deviation; a constant column is 0."""
    return df.withColumns({c: (F.col(c) - mean) / dev if dev else F.lit(0.0) for c, (mean, dev) in scales.items()}) if scales else df


def fit_cells(ready: DataFrame, label: str, inputs: tuple[Sequence[str], Sequence[str]], scales: dict[str, tuple[float, float]]) -> DataFrame:
    """The distinct rows of (numeric, categorical) ``inputs`` and the label, scaled, in tasks of ``FIT_ROWS`` rows."""
    numbers, places = [f"num_{c}" for c in inputs[0]], [f"ix_{c}" for c in inputs[1]]
    cells = pin(distinct_rows(ready, [label, *numbers, *places], COPIES))
    # as few tasks as the rows need: the many jobs of a fit share the cores with those of other fits
    return standardized(cells.repartition(max(1, -(-cells.count() // FIT_ROWS))), {c: scales[c] for c in numbers})


def encoder_stages(enc: Encoding, numeric: Sequence[str], categorical: Sequence[str], *, scale: bool) -> list:
    """Assemble scaled numbers and one-hot categories; an unseen category is all zeros."""
    stages, inputs = [], []
    if numeric:
        stages.append(VectorAssembler(inputCols=[f"num_{c}" for c in numeric], outputCol="_numbers"))
        if scale:
            stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True))
        inputs.append("_scaled" if scale else "_numbers")
    used = [c for c in categorical if enc.slots[c]]
    if used:
        # the number of slots stands in the column's metadata; unseen values are in the last one, which dropLast removes
        stages.append(OneHotEncoder(inputCols=[f"ix_{c}" for c in used], outputCols=[f"oh_{c}" for c in used], dropLast=True))
        inputs += [f"oh_{c}" for c in used]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def estimator(kind: str, label: str, rows: int, seed: int = 0, **params):
    """The three baseline families with the usual library defaults."""
    if kind == "tree":
        defaults = {"maxDepth": 2, "impurity": "gini", "seed": seed}
        return DecisionTreeClassifier(labelCol=label, **{**defaults, **params})
    if kind == "logistic":
        # unit-strength L2 on the sum of losses = 1/n on their mean
        defaults = {"regParam": 1.0 / max(1, rows), "elasticNetParam": 0.0, "standardization": False, "maxIter": 100}
        return LogisticRegression(labelCol=label, **{**defaults, **params})
    if kind == "boosting":
        defaults = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": seed}
        return GBTClassifier(labelCol=label, **{**defaults, **params})
    raise ValueError(f"unknown model kind {kind!r}")


def at_once(calls: Sequence, parallel: int = FITS) -> list:
    """The results of ``calls``, at most ``parallel`` of them at a time: the many short jobs of one fit leave cores idle."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(call)) for call in calls]]


def fit(prepared: DataFrame, enc: Encoding, spec: ModelSpec, label: str, seed: int = 0, weight: str | None = None) -> PipelineModel:
    """Fit one model on rows made by :func:`prepare`. Rows that stand for ``weight`` rows each have their numbers scaled already."""
    stages = encoder_stages(enc, spec.numeric, spec.categorical, scale=weight is None)
    model = estimator(spec.kind, "_label", enc.rows, seed, **spec.params)
    used = [f"num_{c}" for c in spec.numeric] + [f"ix_{c}" for c in spec.categorical]
    if weight:
        model = model.setWeightCol("_weight")
        used.append(F.col(weight).cast("double").alias("_weight"))
    return Pipeline(stages=[*stages, model]).fit(prepared.select(F.col(label).cast("double").alias("_label"), *used))


def score(model: PipelineModel, spec: ModelSpec, prepared: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep..., model, pred, p1, margin`` for every prepared row."""
    scored = model_scores(model.transform(prepared))
    return scored.select(*keep, F.lit(spec.name).alias("model"), F.col("prediction").cast("int").alias("pred"),
                         "p1", "margin")


def fit_and_score(train: DataFrame, test: DataFrame, specs: Sequence[ModelSpec], label: str, keep: Sequence[str], *,
                  missing: str = "None", min_count: int = 1, impute: bool = True, seed: int = 0, parallel: int = FITS,
                  weight: str | None = None) -> DataFrame:
    """The long prediction table of several models on the same test rows.

    Medians, scales and categories are learnt once, from the training rows, for all models. Training rows that are equal in
    the inputs of a model and the label are one row with a weight, which is what its fit reads, many times: as written down, in
    tasks of about ``FIT_ROWS`` rows. Rows of ``train`` may stand for ``weight`` rows each. ``parallel`` fits run at a time. Test
    rows are prepared once and written down, so that each model is one scan of them.
    """
    numeric = list(dict.fromkeys(c for s in specs for c in s.numeric))
    categorical = list(dict.fromkeys(c for s in specs for c in s.categorical))
    rows = pin(distinct_rows(train, [label, *numeric, *categorical], weight))
    enc = learn_encoding(rows, numeric, categorical, missing=missing, min_count=min_count, impute=impute, weight=COPIES)
    ready = pin(prepare(rows, enc, numeric, categorical, missing).drop(*numeric, *categorical))
    scales = column_scales(ready, [f"num_{c}" for c in numeric])
    cells = {used: fit_cells(ready, label, used, scales) for used in dict.fromkeys((s.numeric, s.categorical) for s in specs)}
    held = pin(standardized(prepare(test, enc, numeric, categorical, missing), scales).select(
        *keep, *[f"num_{c}" for c in numeric], *[f"ix_{c}" for c in categorical]))
    fitted = at_once([lambda spec=spec: fit(cells[spec.numeric, spec.categorical], enc, spec, label, seed, COPIES) for spec in specs], parallel)
    parts = [score(model, spec, held, keep) for model, spec in zip(fitted, specs, strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- feature variants
TIME_PARTS = ("ts_month", "ts_weekday", "ts_hour")
VARIANTS = ("default", "without_rule_fields", "without_rule_fields_and_reason", "without_rule_fields_plus_time")


def variant_columns(vocab: Vocabulary, variant: str, reason: str = "Logistics_Delay_Reason") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(numeric, categorical) columns of a feature variant."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    cats = [c for c in vocab.categorical if variant == "default" or c not in vocab.rule_fields]
    if variant == "without_rule_fields_and_reason":
        cats.remove(reason)
    if variant == "without_rule_fields_plus_time":
        cats += TIME_PARTS
    return vocab.numeric, tuple(cats)


def with_time_parts(df: DataFrame, column: str = "Timestamp") -> DataFrame:
    """Month, weekday and hour of a timestamp kept as text; unreadable ones stay null."""
    ts = F.col(column).try_cast("timestamp_ntz")
    return df.withColumns({"ts_month": co.month_text(ts), "ts_weekday": co.weekday_text(ts),
                           "ts_hour": F.hour(ts).cast("string")})


def baseline_specs(vocab: Vocabulary, boosting: dict | None = None) -> list[ModelSpec]:
    """Tree, logistic regression and boosting on all columns; boosting on the ablations."""
    specs = [ModelSpec(name, kind, *variant_columns(vocab, "default"))
             for name, kind in (("decision_tree_depth2", "tree"), ("logistic_regression", "logistic"))]
    specs += [ModelSpec("gradient_boosting" + ("" if v == "default" else f"_{v}"), "boosting",
                        *variant_columns(vocab, v)) for v in VARIANTS]
    if boosting:
        specs = [replace(s, params=boosting) if s.kind == "boosting" else s for s in specs]
    return specs


def trivial_predictions(df: DataFrame, vocab: Vocabulary, keep: Sequence[str]) -> DataFrame:
    """The rule and the all-positive predictor, long."""
    ruled = apply_rule(df, vocab.clauses, "_rule")
    models = F.array(F.struct(F.lit("rule_delayed_or_heavy").alias("model"), F.col("_rule").alias("pred")),
                     F.struct(F.lit("all_positive").alias("model"), F.lit(1).alias("pred")))
    return ruled.select(*keep, F.explode(models).alias("_m")).select(*keep, "_m.model", "_m.pred")


# ---------------------------------------------------------------- cross-validation
def cross_validate(df: DataFrame, label: str, keys: Sequence[str], specs: Sequence[ModelSpec], *, k: int = 5,
                   repeats: int = 3, seed: int = 0, **options) -> DataFrame:
    """Out-of-fold predictions of every (model, repeat, fold), long.

    The rows are reduced to distinct training rows once per repeat, by fold; every fit starts from these. ``FOLDS`` folds are
    worked on at a time; the predictions of each are written down.
    """
    folded = pin(stratified_folds(df, label, keys, k, repeats, seed))
    inputs = list(dict.fromkeys(c for s in specs for c in (*s.numeric, *s.categorical)))
    cells = [pin(distinct_rows(folded, [f"fold_{r}", label, *inputs])) for r in range(repeats)]

    def out_of_fold(r: int, f: int) -> DataFrame:
        inside = F.col(f"fold_{r}") == f
        scored = fit_and_score(cells[r].filter(~inside), folded.filter(inside), specs, label, [*keys, label],
                               seed=seed + r * k + f, weight=COPIES, **options)
        return pin(scored.withColumns({"repeat": F.lit(r), "fold": F.lit(f)}))

    parts = at_once([lambda r=r, f=f: out_of_fold(r, f) for r in range(repeats) for f in range(k)], FOLDS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_rows(df: DataFrame, label: str, keys: Sequence[str], k: int, repeats: int, seed: int) -> DataFrame:
    """Every row once per repeat, with ``repeat`` and ``fold``."""
    folded = stratified_folds(df, label, keys, k, repeats, seed)
    cells = F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(f"fold_{r}").alias("fold")) for r in range(repeats)])
    return folded.select(*df.columns, F.explode(cells).alias("_f")).select(*df.columns, "_f.repeat", "_f.fold")


def cv_summary(predictions: DataFrame, label: str, score_column: str | None = None) -> DataFrame:
    """Mean, smallest and largest accuracy (and AUROC) over folds, per model."""
    by = ["model", "repeat", "fold"]
    per_fold = classification_metrics(predictions, label, "pred", by).select(*by, "acc")
    metrics = ["acc"]
    if score_column:
        per_fold = join_groups(per_fold, auroc(predictions, label, score_column, by).select(*by, "auroc"), by, "left")
        metrics.append("auroc")
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return per_fold.groupBy("model").agg(F.count("*").alias("folds"), *aggs)


__all__ = [
    "Encoding", "ModelSpec", "baseline_specs", "cross_validate", "cv_summary", "estimator", "fit", "fit_and_score",
    "fold_rows", "learn_encoding", "prepare", "score", "trivial_predictions", "variant_columns",
    "with_time_parts",
]
