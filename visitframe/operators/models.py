"""Models on Spark ML. Every fit takes a table with `split` and returns a scorer: DataFrame → DataFrame with `p`.

Preparation (median fill, missing flags, standardisation) is fitted on training
rows. The training table is staged once; refits of an ablation are independent
jobs over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.columns import logit, sigmoid
from visitframe.operators.boosting import Booster, Settings, scorer
from visitframe.operators.forest import Forest
from visitframe.operators.forest import scorer as forest_scorer
from visitframe.operators.metrics import auroc, bootstrap, ranking_metrics, score_cells
from visitframe.operators.pit import percentile_of
from visitframe.operators.profile import unpivot
from visitframe.operators.splits import Prep, mask_groups, modality_dropout
from visitframe.scaling import exact_quantiles, null_safe_join
from visitframe.session import stage

Scorer = Callable[[DataFrame], DataFrame]


class Design:
    """Prepared feature vector `x` for a list of features."""

    def __init__(self, df: DataFrame, features: Sequence[str]):
        self.prep = Prep(features).fit(df.where("split = 'train'"))
        self.assembler = VectorAssembler(inputCols=self.prep.columns, outputCol="x")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.assembler.transform(self.prep.transform(df)).drop(*self.prep.columns)


def _positive(df: DataFrame) -> DataFrame:
    return df.withColumn("p", vector_to_array("probability")[1]).drop("x", "probability", "rawPrediction", "prediction")


def _auc(df: DataFrame) -> float:
    v = auroc(df).first()
    return -1.0 if v is None or v["auroc"] is None else float(v["auroc"])


def _best(fits, scorers, val: DataFrame):
    """The fit with the highest AUROC on the validation rows."""
    scored = [(_auc(s(val)), i) for i, s in enumerate(scorers)]
    return fits[max(scored, key=lambda x: (x[0], -x[1]))[1]]


def fit_logistic(df: DataFrame, features: Sequence[str], target: str = "y", grid: Sequence[float] = (0.01, 0.03, 0.1, 0.3, 1.0), seed: int = 0) -> Scorer:
    """L2 logistic regression; the strength is chosen on the validation rows."""
    design = Design(df, features)
    train = design(df.where("split = 'train'")).cache()
    n = train.count()
    fits = [LogisticRegression(featuresCol="x", labelCol=target, regParam=1.0 / (c * n), standardization=False, maxIter=200).fit(train) for c in grid]
    val = df.where("split = 'val'").withColumnRenamed(target, "y") if target != "y" else df.where("split = 'val'")
    scorers = [lambda d, m=m: _positive(m.transform(design(d))) for m in fits]
    best = fits[0] if len(fits) == 1 else _best(fits, scorers, val)
    train.unpersist()
    score = lambda d: _positive(best.transform(design(d)))
    score.model, score.design = best, design
    return score


def fit_forest(df: DataFrame, features: Sequence[str], target: str = "y", trees: int = 500, leaf: int = 10, depth: int = 30, seed: int = 0) -> Scorer:
    """Random forest; the leaf size ends the growth, 30 levels are seldom reached."""
    prep = Prep(features).fit(df.where("split = 'train'"))
    forest = Forest(prep.transform(df), prep.columns, target, trees, leaf, depth, seed)
    return forest_scorer(forest, prep.transform)


def fit_boosted(df: DataFrame, features: Sequence[str], target: str = "y", depths: Sequence[int] = (3, 4, 6), rounds: int = 3000, step: float = 0.03,
                patience: int = 100, seed: int = 0) -> Scorer:
    """Histogram boosting with missing values as they are; rounds end and the depth is chosen by validation AUROC."""
    models = Booster(df, features, target, Settings(step=step, seed=seed)).fit(depths, rounds, patience)
    return scorer(max(models, key=lambda m: m.score), probability=True)


def fit_mlp(df: DataFrame, features: Sequence[str], target: str = "y", hidden: Sequence[int] = (128, 64), iterations: int = 100, seed: int = 0) -> Scorer:
    design = Design(df, features)
    m = MultilayerPerceptronClassifier(featuresCol="x", labelCol=target, layers=[len(design.prep.columns), *hidden, 2], maxIter=iterations, seed=seed).fit(
        design(df.where("split = 'train'")))
    return lambda d: _positive(m.transform(design(d)))


def fit_change(df: DataFrame, features: Sequence[str], target: str, rounds: int = 3000, depth: int = 4, step: float = 0.03, patience: int = 100, seed: int = 0) -> Scorer:
    """Boosted regression trees with absolute error; rounds end by the error on the validation rows."""
    model, = Booster(df, features, target, Settings(step=step, absolute=True, seed=seed)).fit([depth], rounds, patience)
    return scorer(model, probability=False)


def predictions(df: DataFrame, scorers: dict[str, Scorer], keep: Sequence[str], seed: int = 0) -> DataFrame:
    """Long table of predictions, one row per row and model."""
    out = None
    for name, s in scorers.items():
        one = s(df).select(*keep, F.lit(name).alias("model"), F.lit(seed).alias("seed"), "p")
        out = one if out is None else out.unionByName(one)
    return out


# ---- experiments ------------------------------------------------------------------

def ablation_sets(groups: dict[str, Sequence[str]], early: Sequence[str] = (), proximal: Sequence[str] = ()) -> dict[str, list[str]]:
    """Named feature sets: all, each group alone, cumulative, each group left out, early groups plus one, plus proximal."""
    every = [f for fs in groups.values() for f in fs]
    sets, used = {"all": every}, []
    for g, fs in groups.items():
        used = [*used, *fs]
        sets |= {f"alone: {g}": list(fs), f"cumulative: {g}": list(used), f"without: {g}": [f for f in every if f not in fs]}
    first = [f for g in early for f in groups[g]]
    if first:
        sets["early"] = first
        sets |= {f"early + {g}": [*first, *fs] for g, fs in groups.items() if g not in early}
    if proximal:
        sets["with proximal"] = [*every, *proximal]
    return {k: v for k, v in sets.items() if v}


def ablate(df: DataFrame, sets: dict[str, Sequence[str]], fit: Callable[[DataFrame, Sequence[str]], Scorer], by: Sequence[str] = ("split",),
           seeds: Sequence[int] = (0,), key: str = "entity_id", draws: int = 0) -> DataFrame:
    """AUROC of every feature set on the held-out rows, and its distance from `all`.

    `key` names a row (a visit, if entities have several). With `draws` the distance has a 95% interval over paired replicates.
    """
    df = stage(df, "ablation")
    held = df.where("split IN ('test', 'external')")
    out = None
    for name, feats in sets.items():
        runs = None
        for seed in seeds:
            one = fit(df, feats, seed=seed)(held).select(key, *by, "y", F.lit(name).alias("features"), F.lit(seed).alias("seed"), "p")
            runs = one if runs is None else runs.unionByName(one)
        mean = runs.groupBy("features", key, *by, "y").agg(F.avg("p").alias("p"))
        out = mean if out is None else out.unionByName(mean)
    if draws:
        out = stage(out, "ablation-scores")
    a = auroc(out, ["features", *by])
    ref = a.where("features = 'all'").select(*by, F.col("auroc").alias("ref"))
    a = null_safe_join(a, ref, by).withColumn("delta_from_all", F.col("auroc") - F.col("ref")).drop("ref")
    return null_safe_join(a, paired_gain(out, out.where("features = 'all'"), key, ["features", *by], draws), ["features", *by]) if draws else a


def paired_gain(scores: DataFrame, reference: DataFrame, key: str, by: Sequence[str], draws: int) -> DataFrame:
    """`delta_auroc_lo`, `delta_auroc_hi` per group: scores against the reference's score of the same row, on the same replicates."""
    pairs = scores.select(*by, key, "y", "p").join(reference.select(key, F.col("p").alias("p_ref")), key)
    return bootstrap(pairs, by, key, draws, p_ref="p_ref", method="cells", precision=False).select(*by, "delta_auroc_lo", "delta_auroc_hi")


def by_group(df: DataFrame, sets: dict[str, Sequence[str]], fit, group: str, key: str = "entity_id", seeds: Sequence[int] = (0,), draws: int = 0) -> DataFrame:
    """Feature sets scored inside each baseline group: one model for everyone, and models trained inside the group."""
    df = stage(df, "by-group")
    overall = ablate(df, sets, fit, by=("split", group), seeds=seeds, key=key, draws=draws).withColumn("trained_on", F.lit("all"))
    for (level,) in df.select(group).distinct().orderBy(group).collect():
        own = ablate(df.where(F.col(group).eqNullSafe(F.lit(level))), sets, fit, by=("split", group), seeds=seeds, key=key, draws=draws).withColumn("trained_on", F.lit("own group"))
        overall = overall.unionByName(own)
    return overall


def compare_patterns(df: DataFrame, groups: dict[str, Sequence[str]], patterns: dict[str, Sequence[str]], always: Sequence[str], fit, key: str = "entity_id",
                     draws: int = 0) -> DataFrame:
    """Under each availability pattern: ordinary model, model trained with blanked copies, and a model of its own.

    With `draws` also the interval of each model's gain over the ordinary one, on paired replicates.
    """
    df = stage(df, "patterns")
    feats = [*always, *[f for fs in groups.values() for f in fs]]
    held = df.where("split IN ('test', 'external')")
    learn = df.where("split IN ('train', 'val')")
    standard = fit(df, feats)
    dropout = fit(modality_dropout(learn, groups, key).drop("copy"), feats)
    masked = mask_groups(held, groups, patterns)
    cols = [key, "split", "y", "pattern", "p"]
    out = (standard(masked).select(*cols, F.lit("standard").alias("model"))
           .unionByName(dropout(masked).select(*cols, F.lit("dropout").alias("model"))))
    for name, avail in patterns.items():
        own = fit(df, [*always, *[f for g in avail for f in groups[g]]])
        out = out.unionByName(own(held.withColumn("pattern", F.lit(name))).select(*cols, F.lit("specialist").alias("model")))
    g = ["pattern", "model", "split"]
    if not draws:
        return ranking_metrics(score_cells(out, g), g)
    out = stage(out, "pattern-scores").withColumn("row", F.concat_ws("|", "pattern", F.col(key).cast("string")))
    gain = paired_gain(out, out.where("model = 'standard'"), "row", g, draws)
    return ranking_metrics(score_cells(out, g), g).join(gain, g, "left")


# ---- late fusion --------------------------------------------------------------------

def fit_fusion(df: DataFrame, cols: Sequence[str], target: str = "y", c: float = 1.0) -> dict:
    """Small logistic model on the clinical log-odds, a few measures and their missing flags; constant columns are dropped."""
    known = {r["variable"]: r["m"] for r in exact_quantiles(unpivot(df, [], cols), ["variable"], "value", {"m": 0.5}).collect()}
    med = {x: known.get(x, 0.0) for x in cols}
    d = df.withColumns(fusion_design(cols, med))
    names = ["clin_logit", *[n for x in cols for n in (f"d_{x}", f"{x}_missing")]]
    stats = d.agg(F.count("*").alias("n"), *[a for x in names for a in (F.avg(x).alias(f"m_{x}"), F.stddev_pop(x).alias(f"s_{x}"))]).first()
    keep = [x for x in names if stats[f"s_{x}"] and stats[f"s_{x}"] > 0]
    z = d.select(target, *[((F.col(x) - stats[f"m_{x}"]) / stats[f"s_{x}"]).alias(x) for x in keep])
    x = VectorAssembler(inputCols=keep, outputCol="x").transform(z)
    m = LogisticRegression(featuresCol="x", labelCol=target, regParam=1.0 / (c * stats["n"]), standardization=False, maxIter=200).fit(x)
    return {"cols": list(cols), "median": med, "columns": keep, "mean": [stats[f"m_{k}"] for k in keep], "sd": [stats[f"s_{k}"] for k in keep],
            "coef": [float(v) for v in m.coefficients], "intercept": float(m.intercept)}


def fusion_design(cols: Sequence[str], med: dict) -> dict[str, Column]:
    return {n: e for x in cols for n, e in ((f"d_{x}", F.coalesce(F.col(x).cast("double"), F.lit(float(med[x])))),
                                            (f"{x}_missing", F.col(x).isNull().cast("double")))}


def apply_fusion(df: DataFrame, params: dict, out: str = "p_fused") -> DataFrame:
    """Fused risk as a column expression from the parameters; needs `clin_logit`."""
    d = df.withColumns(fusion_design(params["cols"], params["median"]))
    eta = F.lit(float(params["intercept"]))
    for c, m, s, w in zip(params["columns"], params["mean"], params["sd"], params["coef"]):
        eta = eta + (F.col(c) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
    return d.withColumn(out, sigmoid(eta)).drop(*fusion_design(params["cols"], params["median"]))


# ---- batch scoring --------------------------------------------------------------------

def score_flags(df: DataFrame, groups: dict[str, Sequence[str]], edges: Column, cognitive: Sequence[str], p: str = "p") -> DataFrame:
    """Percentile in the reference, used and missing groups, number of filled features, and a flag for no cognitive input."""
    present = {g: F.coalesce(*[F.col(f).cast("string") for f in fs]).isNotNull() for g, fs in groups.items()}
    names = lambda keep: F.concat_ws(", ", *[F.when(c if keep else ~c, F.lit(g)) for g, c in present.items()])
    feats = [f for fs in groups.values() for f in fs]
    filled = F.lit(0)
    for f in feats:
        filled = filled + F.col(f).isNotNull().cast("int")
    none = F.lit(True)
    for g in cognitive:
        none = none & ~present[g]
    df = df.withColumn("__edges", edges)
    return df.withColumns({"percentile": percentile_of(F.col(p), F.col("__edges")), "used": names(True), "missing": names(False), "features_filled": filled,
                           "features_total": F.lit(len(feats)), "no_cognitive_information": none}).drop("__edges")


def clinical_logit(df: DataFrame, p: str = "p") -> DataFrame:
    return df.withColumn("clin_logit", logit(p))
