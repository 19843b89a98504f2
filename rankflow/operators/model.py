"""Model fit and score.

* O1 ``MatrixPrep``: cardinality-routed encoding, datetimes to epoch
  seconds, median imputation and ``VectorAssembler``, all fitted on train.
* O2-O5 the histogram booster of ``boost``: ``fit_ranker`` (lambdarank or a
  listwise softmax, leaf-wise trees) and ``fit_gbt`` (squared loss, symmetric
  trees), both ended by a validation score.
* O2 ``PairwiseRanker``: a linear ranker trained on score differences. Each
  non-selected option is paired with the centroid of its session's selected
  options, so the pair table has one row per negative (never all pairs of a
  session); with one positive per session this is the full pairwise set.
* O6 ensemble and ``fit_blend``, O7 grouped CV and O8 search (all models in the
  same passes over the data), O9 importances, O10 submission, O11 grading.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.ranking import dense_rank_desc, strict_rank
from . import metrics as M
from .boost import METRICS, RANKER, SQUARED, Blocks, BoostParams, Fit, ForestModel, bin_blocks, boost, fit_boosted
from .clean import MedianImputer, datetimes_to_epoch
from .encode import CardinalityEncoder
from .split import fold_frames
from ..session import checkpoint

EXCLUDE = ("Id", "ranker_id", "selected")

# Search ranges (the first on a log scale, whole numbers where both ends are).
SEARCH_SPACE = {"learning_rate": (0.01, 0.2), "num_leaves": (31, 127), "feature_fraction": (0.6, 1.0), "bagging_fraction": (0.6, 1.0),
                "bagging_freq": (1, 10), "min_data_in_leaf": (10, 50), "lambda_l1": (0.0, 1.0), "lambda_l2": (0.0, 1.0)}
LOG_SCALE = ("learning_rate",)
SEARCH_TRIALS, SEARCH_FOLDS = 100, 3
CV_FOLDS = 5
CV_RANKER = replace(RANKER, rounds=1000, patience=100)      # of a cross-validation and of a search


# ---------------------------------------------------------------- O1

class MatrixPrepModel:
    def __init__(self, encoder, imputer, assembler, feature_cols):
        self.encoder, self.imputer, self.assembler = encoder, imputer, assembler
        self.feature_cols = feature_cols

    def transform(self, df: DataFrame, keep=("Id", "ranker_id", "selected")) -> DataFrame:
        x = self.encoder.transform(df) if self.encoder else df
        x = datetimes_to_epoch(x)
        x = x.withColumns({c: F.col(c).cast("double") for c in self.feature_cols if c in x.columns})
        x = self.imputer.transform(x)
        for c in self.feature_cols:           # a column the test side lacks counts as missing
            if c not in x.columns:
                x = x.withColumn(c, F.lit(None).cast("double"))
        x = x.fillna(0.0, subset=self.feature_cols)
        return self.assembler.transform(x).select(*[c for c in keep if c in x.columns], "features")


class MatrixPrep:
    """O1: turn a feature table into ``(Id, ranker_id, selected, features)``.
    Every statistic (codes, frequencies, medians) comes from the training
    rows only; each fit is one aggregate job."""

    def __init__(self, exclude=EXCLUDE, threshold: int = 1000):
        self.exclude, self.threshold = tuple(exclude), threshold

    def fit_transform(self, train: DataFrame) -> tuple[MatrixPrepModel, DataFrame]:
        """Fit and transform one stored copy of ``train``: the fits run several
        jobs over it, and the transform does not derive it again."""
        from ..session import materialize
        train = materialize(train, "prep-input")
        model = self.fit(train)
        return model, model.transform(train)

    def fit(self, train: DataFrame) -> MatrixPrepModel:
        strings = [f.name for f in train.schema.fields
                   if isinstance(f.dataType, StringType) and f.name not in self.exclude]
        enc = CardinalityEncoder(strings, threshold=self.threshold).fit(train) if strings else None
        x = datetimes_to_epoch(enc.transform(train) if enc else train)
        feats = [f.name for f in x.schema.fields
                 if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in self.exclude]
        x = x.withColumns({c: F.col(c).cast("double") for c in feats})
        imp = MedianImputer(feats).fit(x)
        asm = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
        return MatrixPrepModel(enc, imp, asm, feats)


# ---------------------------------------------------------------- O3 / O4 / O5

def hold_out(train: DataFrame, group: str = "ranker_id") -> tuple[DataFrame, DataFrame]:
    """A fifth of the sessions held out for validation, by a hash that is independent of the folds'."""
    part = F.pmod(F.xxhash64(F.col(group), F.lit("validation")), F.lit(5))
    return train.filter(part != 0), train.filter(part == 0)


def fit_gbt(train: DataFrame, validation: DataFrame | None = None, label: str = "selected",
            params: BoostParams = SQUARED, **changes) -> ForestModel:
    """O3 + O4: squared loss, symmetric trees; the squared error of
    ``validation`` ends the fit, and the best round counts. Without it, and
    without a number of ``rounds``, sessions of ``train`` are held out."""
    if validation is None and "rounds" not in changes:
        train, validation = hold_out(train)
    return fit_boosted(train, validation, params, label=label, **changes)


def fit_ranker(train: DataFrame, validation: DataFrame | None = None, label: str = "selected",
               params: BoostParams = RANKER, **changes) -> ForestModel:
    """O2 + O4: the same with a session objective; NDCG ends the fit."""
    return fit_gbt(train, validation, label, params, **changes)


def score(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Batch score."""
    return model.transform(df, out)


# ---------------------------------------------------------------- O2 pairwise

def _sub_vectors(a: Column, b: Column) -> Column:
    return array_to_vector(F.zip_with(vector_to_array(a), vector_to_array(b), lambda x, y: x - y))


@dataclass
class PairwiseRankerModel:
    coefficients: list[float]

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        w = F.array(*[F.lit(float(c)) for c in self.coefficients])
        dot = F.aggregate(F.zip_with(vector_to_array(F.col("features")), w, lambda x, y: x * y),
                          F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn(out, dot)


@dataclass
class PairwiseRanker:
    """O2 (pairwise form): logistic regression without intercept on
    ``x_pos_centroid - x_neg`` (label 1) and its negation (label 0)."""
    regParam: float = 0.1
    elasticNetParam: float = 0.5
    maxIter: int = 50
    group: str = "ranker_id"
    label: str = "selected"

    def pairs(self, df: DataFrame) -> DataFrame:
        pos = (df.filter(F.col(self.label) == 1).groupBy(self.group)
                 .agg(Summarizer.mean(F.col("features")).alias("_pos")))
        neg = df.filter(F.coalesce(F.col(self.label), F.lit(0)) != 1)
        j = neg.join(pos, self.group, "inner")
        d = _sub_vectors(F.col("_pos"), F.col("features"))
        one = j.select(d.alias("features"), F.lit(1.0).alias("label"))
        zero = j.select(_sub_vectors(F.col("features"), F.col("_pos")).alias("features"), F.lit(0.0).alias("label"))
        return one.unionByName(zero)

    def fit(self, df: DataFrame) -> PairwiseRankerModel:
        lr = LogisticRegression(featuresCol="features", labelCol="label", fitIntercept=False,
                                regParam=self.regParam, elasticNetParam=self.elasticNetParam,
                                maxIter=self.maxIter, standardization=True)
        m = lr.fit(self.pairs(df))
        return PairwiseRankerModel([float(c) for c in m.coefficients.toArray()])


# ---------------------------------------------------------------- O6

def ensemble(df: DataFrame, scores: dict[str, float], out: str = "score") -> DataFrame:
    """Weighted blend of score columns, weights normalised to sum 1."""
    total = float(sum(scores.values()))
    expr = sum((F.col(c) * F.lit(w / total) for c, w in scores.items()), F.lit(0.0))
    return df.withColumn(out, expr)


# fixed values: share of the ranker and of the squared-loss model in the blend
BLEND = {"ranker": 0.7, "squared": 0.3}


@dataclass
class BlendModel:
    """Weighted scores of several models."""
    models: dict
    weights: dict

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        for name, m in self.models.items():
            df = m.transform(df, f"_{name}")
        return ensemble(df, {f"_{n}": w for n, w in self.weights.items()}, out).drop(*[f"_{n}" for n in self.models])

    def importances(self, feature_cols: list[str]) -> list[tuple[str, float, int]]:
        return next(iter(self.models.values())).importances(feature_cols)


def fit_blend(train: DataFrame, validation: DataFrame | None = None, label: str = "selected",
              ranker: BoostParams = RANKER, squared: BoostParams = SQUARED, weights: dict | None = None) -> BlendModel:
    """The ranker and the squared-loss model, fitted in the same passes
    over the same blocks, each ended by its own validation score."""
    if validation is None:
        train, validation = hold_out(train)
    cols = ["Id", "ranker_id", label, "features"]
    blocks = bin_blocks(train.select(*cols, F.lit(1).alias("_fold")).unionByName(validation.select(*cols, F.lit(0).alias("_fold"))),
                        "_fold", label=label)
    fits = boost(blocks, {"ranker": Fit(ranker, 0), "squared": Fit(squared, 0)})
    return BlendModel({k: ForestModel(f, blocks.bounds) for k, f in fits.items()}, weights or BLEND)


# ---------------------------------------------------------------- O7 / O8

def evaluate(scored: DataFrame, score_col: str = "score", label: str = "selected",
             group: str = "ranker_id", k: int = 3) -> DataFrame:
    """HitRate@k (row form, dense ranks as in CV) over all and large
    sessions, plus the session form; one row."""
    r = scored.withColumn("rank", dense_rank_desc(score_col, group))
    a = M.hitrate_rows(r, "rank", label, group, k, 0).select(F.col("hitrate").alias("hitrate_all"))
    b = M.hitrate_rows(r, "rank", label, group, k, M.LARGE_SESSION).select(F.col("hitrate").alias("hitrate_large"))
    c = M.hitrate_sessions(scored, score_col, label, group, k, M.LARGE_SESSION).select(
        F.col("hitrate").alias("hitrate_sessions"))
    from ..functions.indexing import attach_row
    return attach_row(attach_row(a, b), c)


def _rates(fit: Fit) -> tuple[float, float, float]:
    """HitRate of all rows, of large sessions' rows and of large sessions, at the best round."""
    if not fit.history:
        return 0.0, 0.0, 0.0
    m = dict(zip(METRICS, fit.history[max(fit.best_round, 1) - 1]))
    return (m["hits"] / max(m["positives"], 1), m["large_hits"] / max(m["large_positives"], 1),
            m["session_hits"] / max(m["large_sessions"], 1))


FOLD_SCORES = "fold int, hitrate_all double, hitrate_large double, hitrate_sessions double"


def cross_validate(matrix: DataFrame, k: int = CV_FOLDS, fold_col: str = "fold", fit=None,
                   label: str = "selected", params: BoostParams = CV_RANKER) -> DataFrame:
    """One row per fold with the scores of its held-out sessions by the
    model fitted on the others, ended by them. All folds are fitted in the same
    passes over one stored matrix. With ``fit`` (rows -> model), any other model
    is fitted and scored fold by fold."""
    if fit is None:
        fits = boost(bin_blocks(matrix, fold_col, label=label), {f: Fit(params, f) for f in range(k)})
        return matrix.sparkSession.createDataFrame([(f, *_rates(m)) for f, m in fits.items()], FOLD_SCORES)
    rows = None
    for f in range(k):
        tr, va = fold_frames(matrix, f, fold_col)
        s = fit(tr).transform(va)
        row = evaluate(s.withColumnRenamed("prediction", "score"), "score", label).select(F.lit(f).alias("fold"), "*")
        row = checkpoint(row)   # reliable checkpoint: cuts the fold's lineage
        rows = row if rows is None else rows.unionByName(row)
    return rows


class Proposer:
    """Parameters of the next trials from the scores of finished ones. After
    some random trials, each value is drawn from the density of the best trials'
    values (a kernel around each, and the whole range) and, of several draws, the
    one is taken whose density among the good trials is largest against that among
    the others. Dimensions are independent of each other."""

    def __init__(self, space: dict, seed: int, random_trials: int = 10, draws: int = 24, good_share: float = 0.15):
        self.space, self.rng = space, np.random.default_rng(seed)
        self.random_trials, self.draws, self.good_share = random_trials, draws, good_share
        self.done: list[tuple[dict, float]] = []

    def _unit(self, name: str, value: float) -> float:
        low, high = self.space[name]
        return math.log(value / low) / math.log(high / low) if name in LOG_SCALE else (value - low) / (high - low)

    def _value(self, name: str, u: float):
        low, high = self.space[name]
        if name in LOG_SCALE:
            return round(low * (high / low) ** u, 6)
        return int(round(low + u * (high - low))) if isinstance(low, int) else round(low + u * (high - low), 6)

    def propose(self) -> dict:
        if len(self.done) < self.random_trials:
            return {n: self._value(n, float(self.rng.random())) for n in self.space}
        ranked = sorted(self.done, key=lambda d: -d[1])
        n_good = max(2, math.ceil(self.good_share * len(ranked)))
        out = {}
        for name in self.space:
            good, rest = (np.array([self._unit(name, p[name]) for p, _ in part]) for part in (ranked[:n_good], ranked[n_good:]))
            width = max(0.05, 1.0 / (1 + len(good)))
            at = self.rng.integers(0, len(good) + 1, self.draws)        # the last one stands for the whole range
            u = np.where(at < len(good), self.rng.normal(np.append(good, 0.5)[at], width), self.rng.random(self.draws))
            u = np.clip(u, 0.0, 1.0)

            def density(points):
                kernels = np.exp(-0.5 * ((u[:, None] - points) / width) ** 2) / (width * math.sqrt(2 * math.pi))
                return (kernels.sum(1) + 1.0) / (len(points) + 1)

            out[name] = self._value(name, float(u[np.argmax(density(good) / density(rest))]))
        return out


def search(matrix: DataFrame, n_trials: int = SEARCH_TRIALS, k: int = SEARCH_FOLDS, seed: int = 42, space: dict | None = None,
           at_once: int = 40, params: BoostParams = CV_RANKER, fold_col: str = "fold") -> DataFrame:
    """Trials of the ranker's parameters, each scored by grouped CV; one row
    per trial. ``at_once`` trials are fitted in the same passes, with all their
    folds; when the last fold of one ends, the next is proposed from all that are
    finished and takes its place. A trial's scores are those it would have alone."""
    space = space or SEARCH_SPACE
    proposer, trials, rows, fits = Proposer(space, seed), [], {}, {}

    def more(n: int) -> dict:
        new = {}
        for _ in range(min(n, n_trials - len(trials))):
            trials.append(proposer.propose())
            new |= {(len(trials) - 1, f): Fit(replace(params, **trials[-1]), f) for f in range(k)}
        fits.update(new)
        return new

    def ended(gone) -> dict:
        left.difference_update(gone)
        finished = sorted({t for t, _ in gone if not any((t, f) in left for f in range(k))})
        for t in finished:
            rates = np.array([_rates(fits[t, f]) for f in range(k)]).mean(0)
            proposer.done.append((trials[t], float(rates[1])))
            rows[t] = (t, *trials[t].values(), *map(float, rates[:2]), int(np.mean([fits[t, f].best_round for f in range(k)])))
        new = more(len(finished))
        left.update(new)
        return new

    left = set(more(at_once))
    boost(bin_blocks(matrix, fold_col), dict(fits), feed=ended)
    kinds = ", ".join(f"{n} {'int' if isinstance(low, int) else 'double'}" for n, (low, _) in space.items())
    return matrix.sparkSession.createDataFrame([rows[t] for t in sorted(rows)],
                                               f"trial int, {kinds}, hitrate_all double, hitrate_large double, rounds int")


# ---------------------------------------------------------------- O9 / O10

def feature_importance(model, feature_cols: list[str]) -> DataFrame:
    """Share of the gain and number of splits of each feature, largest first."""
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().createDataFrame(model.importances(feature_cols),
                                                           "feature string, importance double, splits int")


def permutation_importance(model, matrix: DataFrame, feature_cols: list[str], k: int = 3, seed: int = 42,
                           group: str = "ranker_id", label: str = "selected", row_id: str = "Id") -> DataFrame:
    """O9 (permutation): how much HitRate@k of the rows drops when one feature's
    values change places within the sessions; for any model with ``transform``.
    A row takes the value of the next row of its session in a seeded order (md5),
    the last one that of the first. All features are scored in one pass, by one
    copy of each row per feature. One row per feature: ``feature, baseline,
    permuted, drop``. Sessions are followed through a global index of the order, not
    gathered; a session of one row keeps its values."""
    from ..functions.indexing import global_index
    from ..session import materialize
    order = F.md5(F.concat(F.lit(f"{seed}_"), F.col(row_id).cast("string")))
    idx = global_index(matrix.select(F.col(group).alias("g"), F.col(row_id).alias("i"), order.alias("h")), [F.col("g"), F.col("h"), F.col("i")])
    idx = materialize(idx.select("g", "i", "_idx"), "permutation-order")
    after = idx.select((F.col("_idx") - 1).alias("_idx"), F.col("g").alias("g2"), F.col("i").alias("i2"))
    before = idx.select((F.col("_idx") + 1).alias("_idx"), F.col("g").alias("g0"))
    firsts = (idx.join(before, "_idx", "left").filter(~F.col("g").eqNullSafe(F.col("g0")) | F.col("g0").isNull())
              .select(F.col("g").alias("fg"), F.col("i").alias("first")))                  # one per session
    follow = idx.join(after, "_idx", "left").withColumn("ends", ~F.coalesce(F.col("g") == F.col("g2"), F.lit(False)))
    last = follow.filter("ends").join(firsts, F.col("g").eqNullSafe(F.col("fg"))).select(F.col("i").alias("to"), F.col("first").alias("from"))
    partner = follow.filter("NOT ends").select(F.col("i").alias("to"), F.col("i2").alias("from")).unionByName(last)
    vectors = matrix.select(F.col(row_id).alias("from"), vector_to_array("features").alias("other"))
    rows = matrix.select(row_id, group, label, "features").join(partner, F.col(row_id) == F.col("to")).join(vectors, "from")
    own, other = vector_to_array("features"), F.col("other")
    copies = rows.withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(len(feature_cols) - 1))))
    changed = F.transform(own, lambda v, i: F.when(i == F.col("_f"), F.get(other, i)).otherwise(v))
    scored = model.transform(copies.withColumn("features", array_to_vector(changed)).select("_f", row_id, group, label, "features"))
    hits = (scored.withColumn("_r", dense_rank_desc("score", [group, "_f"])).filter(F.col(label) == 1).groupBy("_f")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("_r") <= k, 1).otherwise(0)), F.lit(0)).alias("hits")))
    rates = {r["_f"]: r["hits"] / r["n"] for r in hits.collect()}        # one row per feature
    base = rates.get(-1, 0.0)
    return matrix.sparkSession.createDataFrame(
        [(c, float(base), float(rates.get(j, base)), float(base - rates.get(j, base))) for j, c in enumerate(feature_cols)],
        "feature string, baseline double, permuted double, drop double")


def submission(scored: DataFrame, score_col: str = "score", group: str = "ranker_id",
               row_id: str = "Id", strict: bool = True, skew_safe: bool = False) -> DataFrame:
    """``(Id, ranker_id, selected)`` with ``selected`` an int rank,
    1 = best. ``strict`` (default) gives a permutation per session (ties by
    Id); ``strict=False`` gives dense ranks (ties share a rank).
    ``skew_safe`` computes the same ranks from range-partitioned counts
    instead of a session window (for very large sessions)."""
    if skew_safe:
        from ..functions import skew
        base = scored.select(row_id, group, score_col)
        if strict:
            out = skew.add_strict_rank_skew_safe(base, score_col, group, row_id, name="_rank")
        else:
            out = skew.add_dense_rank_desc_skew_safe(base, score_col, group, name="_rank")
        return out.select(row_id, group, F.col("_rank").cast("int").alias("selected"))
    r = strict_rank(score_col, group, row_id) if strict else dense_rank_desc(score_col, group)
    return scored.select(row_id, group, r.cast("int").alias("selected"))


# ---------------------------------------------------------------- O2 one gradient step

def lambda_gradients(df: DataFrame, score_col: str = "score", label: str = "selected", group: str = "ranker_id",
                     row_id: str = "Id", out: str = "gradient", skew_safe: bool = False) -> DataFrame:
    """``df`` with the lambdarank gradient of each row (the direction in which
    its score should move). Each positive is paired with the other rows of its
    session; a pair pulls both apart by the logistic of their score difference
    times the NDCG that swapping their ranks changes. With one positive per
    session the pairs are as many as the rows. Sessions without a positive,
    and rows without a score, get 0. Row ids are unique."""
    if skew_safe:
        from ..functions.skew import add_strict_rank_skew_safe
        ranked = add_strict_rank_skew_safe(df.select(row_id, group, score_col, label), score_col, group, row_id, name="_r")
    else:
        ranked = df.select(row_id, group, score_col, label, strict_rank(score_col, group, row_id).alias("_r"))
    good = F.coalesce(F.col(label), F.lit(0)) == 1
    ranked = ranked.filter(F.col(score_col).isNotNull()).withColumn("_gain", 1.0 / F.log2(F.col("_r") + 1.0))
    up = ranked.filter(good).select(F.col(group).alias("_g"), F.col(row_id).alias("_i"), F.col(score_col).alias("_si"),
                                    F.col("_gain").alias("_gi"))
    # ideal DCG: the positives on the first ranks
    ideal = (up.groupBy("_g").agg(F.count(F.lit(1)).alias("_p"))
             .select(F.col("_g").alias("_ig"), F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_p").cast("int")),
                                                                       lambda k: 1.0 / F.log2(k + 1.0)),
                                                           F.lit(0.0), lambda a, x: a + x).alias("_ideal")))
    pairs = (ranked.filter(~good).join(up, F.col(group) == F.col("_g")).join(ideal, F.col("_g") == F.col("_ig"))
             .withColumn("_l", F.abs(F.col("_gi") - F.col("_gain")) / F.col("_ideal")
                         / (1.0 + F.exp(F.col("_si") - F.col(score_col)))))
    parts = pairs.select(F.col("_i").alias("_id"), F.col("_l").alias("_d")).unionByName(
        pairs.select(F.col(row_id).alias("_id"), (-F.col("_l")).alias("_d")))
    total = parts.groupBy("_id").agg(F.sum("_d").alias("_sum"))
    return df.join(total, F.col(row_id) == F.col("_id"), "left").withColumn(
        out, F.coalesce(F.col("_sum"), F.lit(0.0))).drop("_id", "_sum")
