"""Price models on pyspark.ml: leakage-safe features, ridge and boosted trees, permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.tables import running, stored
from ..sources import files
from .pricing import baseline_rows, metrics, prediction_errors, split

CATEGORIES = ("category", "uf")
MISSING = "__MISSING__"
#: Tuning candidates, set before results are seen: depth of a tree and least rows of a leaf.
CANDIDATES = ((5, 10), (5, 20), (5, 50), (6, 10), (6, 20), (6, 50), (7, 20), (7, 50))


def engineer(df: DataFrame) -> DataFrame:
    """Add `log_quantity`, `log_price`; missing categories get a marker."""
    out = df.withColumn("log_quantity", F.log1p(F.greatest(F.coalesce("quantity", F.lit(0.0)), F.lit(0.0)))).withColumn("log_price", F.ln(F.greatest("unit_price", F.lit(1e-6))))
    return out.fillna(MISSING, list(CATEGORIES))


def target_mean(train: DataFrame, key: str = "item_key", weight: float = 10.0) -> DataFrame:
    """Smoothed mean log price of each key, from training rows only: `key, prior`."""
    overall = train.agg(F.avg("log_price").alias("_m"))
    per = train.groupBy(key).agg(F.sum("log_price").alias("_s"), F.count("*").alias("_n"))
    return per.crossJoin(F.broadcast(overall)).select(key, ((F.col("_s") + weight * F.col("_m")) / (F.col("_n") + weight)).alias("prior"))  # one row


def with_prior(df: DataFrame, prior: DataFrame, default: float, key: str = "item_key") -> DataFrame:
    return df.join(prior, key, "left").fillna({"prior": default})


def ridge(train: DataFrame, penalty: float = 1e-3) -> PipelineModel:
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in CATEGORIES]
    stages += [OneHotEncoder(inputCols=[f"{c}_i" for c in CATEGORIES], outputCols=[f"{c}_v" for c in CATEGORIES], handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=["log_quantity", "prior"], outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled")]
    stages += [VectorAssembler(inputCols=["scaled", *(f"{c}_v" for c in CATEGORIES)], outputCol="features"), LinearRegression(featuresCol="features", labelCol="log_price", regParam=penalty)]
    return Pipeline(stages=stages).fit(train)


def trees(train: DataFrame, rounds: int = 20, depth: int = 5, step: float = 0.1) -> PipelineModel:
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in CATEGORIES]
    stages += [VectorAssembler(inputCols=["log_quantity", "prior", *(f"{c}_i" for c in CATEGORIES)], outputCol="features")]
    stages += [GBTRegressor(featuresCol="features", labelCol="log_price", maxIter=rounds, maxDepth=depth, stepSize=step, maxBins=64, seed=42)]
    return Pipeline(stages=stages).fit(train)


#: Step sizes that the second stage tries around the best of the first, each with more rounds the smaller it is.
STEPS = (0.03, 0.05, 0.08)


def _fits(both: DataFrame, asked: Sequence[tuple[int, int, float, int]], parallel: int) -> list[tuple]:
    """Of each (depth, least, step, rounds) the rounds kept and the mean absolute validation error; fits run side by side over one stored table."""

    def one(candidate: tuple[int, int, float, int]) -> tuple:
        depth, least, step, rounds = candidate
        model = GBTRegressor(featuresCol="features", labelCol="log_price", maxIter=rounds, maxDepth=depth, minInstancesPerNode=least, stepSize=step, maxBins=64, seed=42, validationIndicatorCol="held", validationTol=0.0).fit(both)
        mae = model.transform(both.filter("held")).agg(F.avg(F.abs(F.col("prediction") - F.col("log_price")))).first()[0]
        return depth, least, step, model.getNumTrees, mae

    with ThreadPool(parallel) as pool:
        return pool.map(inheritable_thread_target(both.sparkSession)(one), asked)


def tuned(
    train: DataFrame, validation: DataFrame, candidates: Sequence[tuple[int, int]] = CANDIDATES, first: tuple[int, int] = (5, 1), rounds: int = 20, step: float = 0.1, steps: Sequence[float] = STEPS, parallel: int = 4
) -> DataFrame:
    """`stage, depth, least, step, rounds, mae_log, gain_pct, rank` of boosted trees by candidate, best first.

    The first stage compares `candidates` and the configuration `first`; the second tries `steps` around the best of
    these. Each fit stops when the squared validation error rises; the gain is over `first`. Equal errors rank by
    stage, depth, least rows and step. The split is by time, so no folds are drawn.
    """
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in CATEGORIES]
    stages += [VectorAssembler(inputCols=["log_quantity", "prior", *(f"{c}_i" for c in CATEGORIES)], outputCol="features")]
    shared = Pipeline(stages=stages).fit(train)
    rows = lambda df, held: shared.transform(df).select("features", "log_price", F.lit(held).alias("held"))
    both = stored(rows(train, False).unionByName(rows(validation, True)))  # read by each fit
    found = [(1, *x) for x in _fits(both, [(d, m, step, rounds) for d, m in dict.fromkeys([first, *candidates])], parallel)]
    best = min(found, key=lambda x: (x[5], x[1], x[2]))
    found += [(2, *x) for x in _fits(both, [(best[1], best[2], s, max(1, round(rounds * step / s))) for s in steps], parallel)]
    out = train.sparkSession.createDataFrame(found, "stage int, depth int, least int, step double, rounds int, mae_log double")  # a row for each candidate
    of_first = F.max(F.when((F.col("stage") == 1) & (F.col("depth") == first[0]) & (F.col("least") == first[1]), F.col("mae_log"))).over(Window.partitionBy())
    out = out.withColumn("gain_pct", F.round(100 * ratio(of_first - F.col("mae_log"), of_first), 4))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("mae_log", "stage", "depth", "least", "step"))).orderBy("rank")


def out_of_time(fitted_on: DataFrame, test: DataFrame, id_column: str, fit: Callable[[DataFrame], PipelineModel] = trees) -> DataFrame:
    """The final protocol: fit on all earlier rows, score the test rows once: `sample` (all, known, unseen) and its metrics.

    Rows are engineered ones without a prior. Raises ValueError if an id repeats or is on both sides. A sample without rows has null metrics.
    """
    for name, df in (("fitted", fitted_on), ("test", test)):
        if df.groupBy(id_column).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            raise ValueError(f"{id_column} repeats in the {name} rows")
    if test.join(fitted_on.select(id_column), id_column, "left_semi").limit(1).count():
        raise ValueError(f"{id_column} is on both sides")
    errors = fitted_errors(fitted_on, test, fit)
    samples = {"all": errors, "known": errors.filter("is_known"), "unseen": errors.filter("not is_known")}
    return reduce(DataFrame.unionByName, (metrics(df).withColumn("sample", F.lit(name)) for name, df in samples.items()))


def fitted_errors(train: DataFrame, later: DataFrame, fit: Callable[[DataFrame], PipelineModel]) -> DataFrame:
    """Errors on `later` of a model fitted on `train`; priors come from `train` alone."""
    prior = stored(target_mean(train))
    default = train.agg(F.avg("log_price")).first()[0] or 0.0
    model = fit(stored(with_prior(train, prior, default)))  # read by every indexer and by the fit
    return prediction_errors(score(model, with_prior(later, prior, default)), train)


def validation_run(name: str, train: DataFrame, validation: DataFrame, fit: Callable[[DataFrame], PipelineModel], root: str, id_column: str) -> DataFrame:
    """Write a model's errors and metrics under `root/name`, both anew, and return its metrics as read back."""
    spark = train.sparkSession
    errors = fitted_errors(train, validation, fit).select(id_column, "item_key", "category", "unit_price", "expected", "log_error", "abs_log_error", "abs_error", "ape", "is_known")
    files.save_artifact(errors, f"{root}/{name}/errors.parquet")
    files.save_artifact(metrics(spark.read.parquet(f"{root}/{name}/errors.parquet")).withColumn("model", F.lit(name)), f"{root}/{name}/metrics.parquet")
    return spark.read.parquet(f"{root}/{name}/metrics.parquet")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with `expected`, the predicted price."""
    return model.transform(df).withColumn("expected", F.exp("prediction"))


def permuted(df: DataFrame, column: str, id_column: str, seed: int = 42) -> DataFrame:
    """`column` dealt anew over all rows: each takes the value of another row, far away in hash order."""
    return variants(df, [column], id_column, seed).filter(F.col("variant") == column).select(df.columns)


def variants(df: DataFrame, columns: Sequence[str], id_column: str, seed: int = 42) -> DataFrame:
    """`df` once as it is (`variant` empty) and once for each of `columns` with that column dealt anew, in one table.

    Rows get ranks in the order of a hash, dealt over tasks by ranges. In the variant of the k-th column a row takes its value
    from the row a fixed share of all ranks further on, so one join serves all variants, and no value is lost.
    """
    ranked = stored(running(df, {"_r": F.lit(1)}, [F.xxhash64(id_column, F.lit(seed)), F.col(id_column)]))
    n = ranked.count()
    shift = [1 + n * (k + 1) // (len(columns) + 2) for k in range(len(columns))]
    which = F.explode(F.array(*(F.struct(F.lit(c).alias("variant"), F.lit(d).alias("_d")) for c, d in zip(["", *columns], [0, *shift], strict=True))))
    wanted = ranked.withColumn("_w", which).select("*", "_w.*").withColumn("_at", F.pmod(F.col("_r") + F.col("_d"), F.lit(max(n, 1))))
    other = ranked.select(F.col("_r").alias("_at"), *(F.col(c).alias(f"_v_{c}") for c in columns))
    dealt = {c: F.when(F.col("variant") == c, F.col(f"_v_{c}")).otherwise(F.col(c)) for c in columns}
    return wanted.join(other, "_at").withColumns(dealt).select(*df.columns, "variant")


def own_importance(model: PipelineModel) -> dict[str, float]:
    """The share of each feature in the gain of a model of boosted trees, none for other models."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return {}
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    return {c.removesuffix("_i"): float(x) for c, x in zip(names, last.featureImportances.toArray(), strict=True)}


def importance(model: PipelineModel, rows: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """`feature, mae, increase, own`: mean absolute error in log price with each feature dealt anew, its rise, and the model's own share of gain.

    The row of empty feature has none dealt. All variants are scored in one job.
    """
    scored = model.transform(variants(rows, columns, id_column))
    out = scored.groupBy(F.col("variant").alias("feature")).agg(F.avg(F.abs(F.col("prediction") - F.col("log_price"))).alias("mae"))
    plain = F.max(F.when(F.col("feature") == "", F.col("mae"))).over(Window.partitionBy())  # a row for each feature
    own = own_importance(model)
    share = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))[F.col("feature")] if own else F.lit(None).cast("double")
    return out.withColumn("increase", F.col("mae") - plain).withColumn("own", share)


def vocabulary(train: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """`name, level, n`: the levels of each column in the training rows."""
    long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in columns))).alias("x")).select("x.*")
    return long.filter("level is not null").groupBy("name", "level").agg(F.count("*").alias("n"))


def with_levels(df: DataFrame, levels: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """Rows whose levels that are not in the vocabulary are `MISSING`, as are null ones."""
    for c in columns:
        own = levels.filter(F.col("name") == c).select(F.col("level").alias("_l"))
        df = df.join(own, F.col(c) == F.col("_l"), "left").withColumn(c, F.coalesce("_l", F.lit(MISSING))).drop("_l")
    return df


def report(fact: DataFrame, years: tuple[int, int, int], fit: Callable[[DataFrame], PipelineModel] | None = None, id_column: str = "id", features: Sequence[str] = ("log_quantity", "prior", *CATEGORIES)) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """From facts to a model's figures: metrics of the validation and test split with the training rows, effects of its features on the training rows, and the model."""
    rows = stored(engineer(split(baseline_rows(fact), *years)))
    train = rows.filter("split = 'train'")
    levels, prior = stored(vocabulary(train)), target_mean(train)
    default, n = train.agg(F.avg("log_price"), F.count("*")).first()
    ready = stored(with_prior(with_levels(rows, levels), stored(prior), default or 0.0))
    model = (fit or trees)(ready.filter("split = 'train'"))
    known = ready.filter("split = 'train'")
    part = lambda name: metrics(prediction_errors(score(model, ready.filter(F.col("split") == name)), known)).withColumns({"split": F.lit(name), "n_train": F.lit(n)})
    effects = importance(model, known, features, id_column)
    return part("validation").unionByName(part("test")), effects, model
