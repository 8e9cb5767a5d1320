"""Batch scoring: any ``DataFrame -> DataFrame`` step that adds a raw answer column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..vocab import Vocabulary
from .classification import with_agreement
from .records import render

#: A scorer reads the text column and adds the raw answer column ``raw``.
Scorer = Callable[[DataFrame], DataFrame]


def keyword_answer(text: Column, target: str, stems: Sequence[str]) -> Column:
    """``target: 1`` when the value part of any line holds a stem (any case), else ``target: 0``."""
    pattern = r"(?im)^[^:\n]*+:[^\n]*?(?:" + "|".join(stems) + ")"
    return F.when(F.regexp_like(text, F.lit(pattern)), f"{target}: 1").otherwise(f"{target}: 0")


def score_texts(df: DataFrame, scorer: Scorer, target: str) -> DataFrame:
    """Add ``raw`` and the parsed ``label`` (null when unparsable)."""
    return scorer(df).withColumn("label", tx.answer_label(F.col("raw"), target))


def score_table(df: DataFrame, scorer: Scorer, vocab: Vocabulary, *, drop_rule_fields: bool = False) -> DataFrame:
    """Render, score, parse and compare every row with the rule.

    ``drop_rule_fields`` hides the rule's fields from the scorer; the rule itself is always
    read from the row.
    """
    fields = [f for f in vocab.fields if not (drop_rule_fields and f in vocab.rule_fields)]
    scored = score_texts(render(df, fields, missing=vocab.missing), scorer, vocab.target)
    return with_agreement(scored.withColumn("rule", rules.any_clause(vocab.clauses)), "label", "rule")


def model_scores(predictions: DataFrame, probability: str = "probability") -> DataFrame:
    """Add ``p1`` and ``margin`` (log-odds of class 1, so that p1 is their softmax).

    A saturated probability of 0 or 1 keeps a large finite margin.
    """
    from pyspark.ml.functions import vector_to_array

    both = predictions.withColumn("_p", vector_to_array(probability))
    odds = [F.log(F.greatest(F.col("_p")[i], F.lit(2.0 ** -1022))) for i in (0, 1)]
    return both.withColumns({"p1": F.col("_p")[1], "margin": odds[1] - odds[0]}).drop("_p")


# --------------------------------------------------------------------- models in workers
#: Bytes of text, and texts, that a model gets at a time.
BATCH_BYTES, BATCH_TEXTS = 1 << 20, 1_024


def model_scorer(load: Callable[[], Callable[[list[str]], dict[str, list]]], outputs: str = "raw string", *, text: str = "text",
                 batch_bytes: int = BATCH_BYTES, batch_texts: int = BATCH_TEXTS) -> Scorer:
    """A scorer that runs a model in the Python workers, and adds its ``outputs`` (a DDL schema) to the rows.

    ``load`` is called once in each worker process, however many tasks it runs, and returns a function from a list of texts to a
    list per output column. It gets consecutive texts of about ``batch_bytes`` bytes and of at most ``batch_texts``; one longer
    text comes alone. A null text is not shown to the model: its outputs are null. An empty text is a text. An
    output that has the name of a column, and a model that returns another number of answers than it got texts, are errors.
    """
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(outputs)
    own = uuid4().hex  # one model per scorer and worker

    def score(df: DataFrame) -> DataFrame:
        taken = {c.lower() for c in df.columns} & {f.name.lower() for f in added.fields}
        if taken:
            raise ValueError(f"columns already present: {', '.join(sorted(taken))}")
        at = df.columns.index(text)
        schema = T.StructType([*df.schema.fields, *added.fields])
        names = schema.names

        def run(batches: Iterator) -> Iterator:
            import sys
            import types

            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            home = sys.modules.setdefault("_labelwright_models", types.ModuleType("_labelwright_models"))
            if not hasattr(home, own):
                setattr(home, own, load())
            predict, kinds = getattr(home, own), [to_arrow_schema(added).field(f.name).type for f in added.fields]

            def scored(part, texts):
                asked = [t for t in texts if t is not None]
                found = predict(asked) if asked else {}
                columns = []
                for field, kind in zip(added.names, kinds, strict=True):
                    answers = iter(found[field] if asked else ())
                    values = [None if t is None else next(answers, KeyError) for t in texts]
                    if KeyError in values or next(answers, KeyError) is not KeyError:
                        raise ValueError(f"the model did not give one {field} per text")
                    columns.append(pa.array(values, kind))
                return pa.RecordBatch.from_arrays([*part.columns, *columns], names=names)

            for batch in batches:
                start, size, texts = 0, 0, []
                for k, value in enumerate(batch.column(at)):
                    one = value.as_py()
                    more = len(one.encode()) if one else 0
                    if texts and (size + more > batch_bytes or len(texts) >= batch_texts):
                        yield scored(batch.slice(start, len(texts)), texts)
                        start, size, texts = k, 0, []
                    texts.append(one)
                    size += more
                if texts:
                    yield scored(batch.slice(start, len(texts)), texts)

        return df.mapInArrow(run, schema)

    return score


#: Lines that a line-weight model knows at most: it is loaded whole into every worker.
KNOWN_LINES = 20_000


def fit_line_weights(texts: DataFrame, label: str, *, text: str = "text", most: int = KNOWN_LINES) -> tuple[float, dict[str, float]]:
    """(prior, weight per line): log-odds of class 1 given the distinct lines of a text, each with one row added to both classes.

    One grouped pass counts the rows of each class per line; the ``most`` frequent lines (ties by text) are kept, so the model has a
    bounded size. Lines are trimmed, empty ones and null texts do not count; rows without a label are left out.
    """
    known = texts.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.array_distinct(
        F.filter(F.transform(tx.text_lines(F.coalesce(F.col(text), F.lit(""))), tx.strip), lambda ln: ln != "")).alias("lines"))
    total = known.agg(F.count_if(F.col("y") == 1).alias("p"), F.count("*").alias("n")).first()
    ones, zeros = total["p"], total["n"] - total["p"]
    lines = known.select("y", F.explode("lines").alias("line")).groupBy("line").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p"))
    weight = F.log(F.col("p") + 1.0) - F.log(F.col("n") - F.col("p") + 1.0) - (F.log(F.lit(ones + 2.0)) - F.log(F.lit(zeros + 2.0)))
    rows = lines.orderBy(F.desc("n"), "line").limit(most).select("line", weight.alias("w")).collect()
    from math import log

    return log(ones + 1.0) - log(zeros + 1.0), {r["line"]: r["w"] for r in rows}


def line_weight_scorer(spark, prior: float, weights: dict[str, float], target: str, **options) -> Scorer:
    """A scorer from ``fit_line_weights``: adds ``raw`` (the answer text), ``margin`` (log-odds) and ``p1``."""
    shared = spark.sparkContext.broadcast((prior, weights))
    blanks = tx.WHITESPACE

    def load():
        from math import exp, fsum

        base, known = shared.value

        def predict(texts: list[str]) -> dict[str, list]:
            margins = []
            for one in texts:
                lines = {ln.strip(blanks) for ln in one.split("\n")}
                margins.append(base + fsum(known[ln] for ln in lines if ln in known))
            return {"raw": [f"{target}: {int(m > 0)}" for m in margins], "margin": margins,
                    "p1": [1 / (1 + exp(-m)) if m > -700 else 0.0 for m in margins]}

        return predict

    return model_scorer(load, "raw string, margin double, p1 double", **options)
