"""Authorship verification: fitting a logistic model over distances, scoring pairs, metrics of decisions."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import stats
from quillframe.plans.registry import FEATURES, SEMANTIC_VERSION
from quillframe.plans.tables import written

ITERATIONS, TOLERANCE, LOGIT_LIMIT = 100, 1e-12, 700.0
#: Steps of at most this size, relative to the weights, that no longer shrink are rounding.
ROUNDING = 1e-9
MODEL_ID = "logistic-verifier-1"


@dataclass(frozen=True)
class Verifier:
    """A fitted model; its size is the number of features."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    t_same: float = 0.5
    t_different: float = 0.5
    platt: tuple[float, float] | None = None
    kind: str = "text"
    languages: tuple[str, ...] = ()
    model_id: str = MODEL_ID
    backend: str = MODEL_ID
    registry_version: str = SEMANTIC_VERSION
    metrics: tuple[str, ...] = ()


def check_model(model: Verifier, pairs: DataFrame, artifacts: DataFrame) -> None:
    """Refuses a model that this library can't score with, and pairs(left, right) of artifacts(artifact_id, kind, language) outside its kind and languages."""
    if model.model_id != MODEL_ID or model.backend != MODEL_ID:
        raise ValueError(f"the model {model.model_id!r} with backend {model.backend!r} isn't {MODEL_ID!r}")
    if model.registry_version != SEMANTIC_VERSION:
        raise ValueError(f"the model's registry {model.registry_version!r} isn't {SEMANTIC_VERSION!r}")
    for i, name in enumerate(model.features):
        if name not in FEATURES:
            raise ValueError(f"the model's feature {name!r} isn't known")
        if model.metrics and model.metrics[i] != FEATURES[name].metric:
            raise ValueError(f"the model's metric of {name!r} isn't {FEATURES[name].metric!r}")
    ends = pairs.select(F.explode(F.array("left", "right")).alias("artifact_id")).join(artifacts.select("artifact_id", "kind", "language"), "artifact_id")
    wrong = F.col("kind") != model.kind
    if model.languages:
        wrong = wrong | ~F.col("language").isin(*model.languages)
    if (bad := ends.filter(F.coalesce(wrong, F.lit(True))).first()) is not None:
        raise ValueError(f"{bad['artifact_id']}: kind {bad['kind']!r} or language {bad['language']!r} is outside the model's scope")


#: Features by prefix that apply to some languages only.
SCOPES = {"text.function_words.en.": {"en"}, "code.python.": {"python"}, "code.toolchain.": {"python"}, "code.parser.": {"javascript", "typescript", "c", "rust"}}


def candidates(kind: str, languages: tuple[str, ...] = (), features: tuple[str, ...] | None = None, linguistic: bool = False) -> list[str]:
    """Features that a model of the kind may use: those that compare, apply to all the languages, and, unless asked for, aren't linguistic."""
    for name in features or ():
        if name not in FEATURES or FEATURES[name].metric == "NONE" or FEATURES[name].kind != kind:
            raise ValueError(f"{name!r} is no feature that compares for the kind {kind!r}")
    chosen = []
    for name in features if features is not None else sorted(FEATURES):
        scope = next((s for p, s in SCOPES.items() if name.startswith(p)), None)
        fits = scope is None or (bool(languages) and set(languages) <= scope)
        if FEATURES[name].metric != "NONE" and FEATURES[name].kind == kind and fits and (linguistic or not name.startswith("text.linguistic.")):
            chosen.append(name)
    return chosen


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) of a clamped logit; null stays null, which greatest() and least() alone would skip."""
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(LOGIT_LIMIT)), F.lit(-LOGIT_LIMIT)))))


def scored(components: DataFrame, model: Verifier) -> DataFrame:
    """components(pair_id, feature_id, value) to (pair_id, used, missing, logit, score, probability, verdict).

    A pair without all the model's features abstains without a score.
    """
    table = [(f, m, s, w) for f, m, s, w in zip(model.features, model.means, model.scales, model.weights)]
    slots = components.sparkSession.createDataFrame(table, "feature_id string, mean double, scale double, weight double")
    pairs = components.select("pair_id").distinct()
    used = components.filter("value is not null").join(F.broadcast(slots), "feature_id")
    sums = used.groupBy("pair_id").agg(F.count(F.lit(1)).alias("used"), F.sum(F.col("weight") * (F.col("value") - F.col("mean")) / F.col("scale")).alias("sum"))
    rows = pairs.join(sums, "pair_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    whole = F.col("used") == len(table)
    logit = F.when(whole, F.coalesce("sum", F.lit(0.0)) + F.lit(model.intercept))
    rows = rows.select("pair_id", "used", (F.lit(len(table)) - F.col("used")).alias("missing"), logit.alias("logit")).withColumn("score", sigmoid(F.col("logit")))
    chance = F.lit(None).cast("double") if model.platt is None else sigmoid(F.col("logit") * model.platt[0] + model.platt[1])
    verdict = F.when(F.col("score").isNull(), "abstain").when(F.col("score") >= model.t_same, "same_author").when(F.col("score") <= model.t_different, "different_author").otherwise("abstain")
    return rows.withColumn("probability", chance).withColumn("verdict", verdict)


def decision_metrics(rows: DataFrame) -> DataFrame:
    """rows(verdict, label, score, probability) to one row: F1, c@1, F0.5u, AUC, Brier."""
    same, right = F.col("label") == "same", F.col("verdict") == "same_author"
    answered = F.col("verdict").isin("same_author", "different_author")
    cells = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(answered & right & same).alias("tp"), F.count_if(answered & right & ~same).alias("fp"), F.count_if(answered & ~right & same).alias("fn"),
        F.count_if(answered & ~right & ~same).alias("tn"), F.count_if(~answered).alias("open"), F.avg(F.pow(F.col("probability") - same.cast("double"), F.lit(2.0))).alias("brier"),
    )
    tp, fp, fn, tn, n, left = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n", "open"))
    auc = stats.rank_auc(rows.filter("score is not null"), [], "score", same)
    known = F.when(tp + fp + fn + tn > 0, F.coalesce(F.try_divide(tp * 2.0, tp * 2 + fp + fn), F.lit(0.0)))
    out = cells.select("n", known.alias("f1"), (((tp + tn) + left * (tp + tn) / n) / n).alias("c_at_1"), F.coalesce(F.try_divide(tp * 1.25, tp * 1.25 + (fn + left) * 0.25 + fp), F.lit(0.0)).alias("f_05u"), "brier")
    return out.withColumn("one", F.lit(1)).join(auc.withColumn("one", F.lit(1)), "one", "left").drop("one")


def pair_values(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, label, feature_id, value) of labelled pairs (pair_id, label)."""
    return components.filter("value is not null").select("pair_id", "feature_id", "value").join(pairs.select("pair_id", "label"), "pair_id")


def supported(values: DataFrame, pairs: DataFrame, fraction: float, class_fraction: float) -> list[str]:
    """Features with values in enough pairs, overall and of each class; at most 90 rows come to the driver."""
    sizes = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    same, different = sizes.get("same", 0), sizes.get("different", 0)
    if not same or not different:
        raise ValueError("pairs of both labels are needed")
    rows = values.groupBy("feature_id").agg(F.count_if(F.col("label") == "same").alias("s"), F.count_if(F.col("label") == "different").alias("d")).collect()
    return sorted(r["feature_id"] for r in rows if (r["s"] + r["d"]) / (same + different) >= fraction and r["s"] / same >= class_fraction and r["d"] / different >= class_fraction)


def design(values: DataFrame, features: list[str]) -> DataFrame:
    """(pair_id, y, x array) of the pairs that have every feature."""
    chosen = values.filter(F.col("feature_id").isin(features))
    rows = chosen.groupBy("pair_id", "label").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("v")).filter(F.size("v") == len(features))
    return rows.select("pair_id", (F.col("label") == "same").cast("double").alias("y"), F.transform("v", lambda e: e["value"]).alias("x"))


def newton(rows: DataFrame, size: int, penalty: float, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights and intercept (last) of the logistic model on rows(y, x): Newton steps on penalised log loss.

    Each step is one aggregation of the gradient and the Hessian, (p + 1)(p + 4) / 2 sums; only those reach the driver.
    Steps are taken for x less its mean in units of its deviation, whose Hessian is well conditioned however close the values lie
    to each other, and the model is given for x as it is. Where sums over many rows round more than the tolerance allows, steps end
    once they are small and no longer shrink.
    """
    x = [F.element_at("x", i + 1) for i in range(size)]
    found = rows.agg(*[f(c) for c in x for f in (F.avg, F.stddev_pop)]).first()
    mean, unit = np.array(found[::2], dtype=float), np.array([v or 1.0 for v in found[1::2]], dtype=float)
    p, w, last = size + 1, np.zeros(size + 1), np.inf
    x = [(c - F.lit(float(m))) / F.lit(float(u)) for c, m, u in zip(x, mean, unit)] + [F.lit(1.0)]
    ridge = np.append(penalty / unit**2, 0.0)
    scaled = rows.select(F.array(*x).alias("x"), "y")
    x = [F.element_at("x", i + 1) for i in range(p)]
    for _ in range(iterations):
        z = sum((F.lit(float(w[i])) * x[i] for i in range(size)), F.lit(float(w[size])))
        mu = sigmoid(z)
        base = scaled.select("x", "y", mu.alias("mu")).withColumn("v", F.col("mu") * (1 - F.col("mu")))
        sums = [F.sum((F.col("mu") - F.col("y")) * x[i]) for i in range(p)] + [F.sum(F.col("v") * x[i] * x[j]) for i in range(p) for j in range(i, p)]
        got = base.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        gradient, hessian = np.array(got[:p], dtype=float), np.zeros((p, p))
        hessian[np.triu_indices(p)] = got[p:]
        hessian += np.triu(hessian, 1).T
        step = np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * w)
        w, most = w - step, np.abs(step).max()
        if most <= tolerance or (last <= ROUNDING * max(1.0, np.abs(w).max()) and most >= last / 2):
            weights = w[:size] / unit
            return np.append(weights, w[size] - weights @ mean)
        last = most
    raise ArithmeticError("the fit didn't converge")


def fitted(components: DataFrame, pairs: DataFrame, candidates: list[str] | None = None, penalty: float = 1.0, fraction: float = 0.9, class_fraction: float = 0.8, calibration: DataFrame | None = None, alpha: float = 0.05, platt: bool = False, tolerance: float = TOLERANCE, fixed: tuple[float, float] | None = None, min_pairs: int = 1, kind: str = "text", languages: tuple[str, ...] = ()) -> Verifier:
    """The model of labelled pairs(pair_id, label); calibration pairs set the thresholds and the probabilities.

    fixed: thresholds (same, different) that aren't fitted. Fewer complete pairs than min_pairs, or none of a class, are refused.
    """
    if platt and calibration is None:
        raise ValueError("probabilities need calibration pairs")
    if fixed is not None and fixed[1] > fixed[0]:
        raise ValueError("the threshold for different must not exceed that for same")
    values = pair_values(components, pairs)
    if candidates is not None:
        values = values.filter(F.col("feature_id").isin(candidates))
    values = written(values, "pair-values")
    features = supported(values, pairs, fraction, class_fraction)
    if not features:
        raise ValueError("no feature has enough support")
    raw = written(design(values, features), "design")
    whole, positive = raw.agg(F.count(F.lit(1)), F.sum("y")).first()
    if whole < min_pairs or not 0 < (positive or 0) < whole:
        raise ValueError(f"{whole} complete pairs, {int(positive or 0)} of them same, aren't enough")
    stats_ = raw.agg(*[f(F.element_at("x", i + 1)) for i in range(len(features)) for f in (F.avg, F.stddev_pop)]).first()
    means, scales = [stats_[2 * i] for i in range(len(features))], [stats_[2 * i + 1] or 1.0 for i in range(len(features))]
    centred = raw.select("y", F.transform(F.arrays_zip("x", F.array(*map(F.lit, means)).alias("m"), F.array(*map(F.lit, scales)).alias("s")), lambda e: (e["x"] - e["m"]) / e["s"]).alias("x"))
    w = newton(written(centred, "design"), len(features), penalty, tolerance=tolerance)
    bounds = fixed or (0.5, 0.5)
    model = Verifier(tuple(features), tuple(means), tuple(scales), tuple(map(float, w[:-1])), float(w[-1]), *bounds, None, kind, languages, metrics=tuple(FEATURES[f].metric for f in features if f in FEATURES))
    if calibration is None:
        return model
    known = scored(components.join(calibration.select("pair_id"), "pair_id", "left_semi"), model).filter("score is not null").join(calibration.select("pair_id", "label"), "pair_id")
    known = written(known.select("label", "score", "logit"), "calibration")
    q = known.agg(F.percentile(F.when(F.col("label") == "same", F.col("score")), F.lit(alpha)).alias("t_same"), F.percentile(F.when(F.col("label") == "different", F.col("score")), F.lit(1 - alpha)).alias("t_different")).first()
    t_same, t_different = fixed or (q["t_same"], q["t_different"])
    if t_different > t_same:
        t_same = t_different = (t_same + t_different) / 2
    slope = None
    if platt:
        a = newton(known.select((F.col("label") == "same").cast("double").alias("y"), F.array("logit").alias("x")), 1, 0.0, tolerance=tolerance)
        slope = (float(a[0]), float(a[1]))
    return replace(model, t_same=t_same, t_different=t_different, platt=slope)
