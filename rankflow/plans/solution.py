"""End-to-end ranking run (the reference's full-pipeline entry points as
one function): validate inputs, derive features, fit encoders / matrix on
train, cross-validate, fit, score the test sessions, check and write the
submission. Every step is a rankflow operator; nothing here collects data
beyond small fitted state and per-fold metric rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators import metrics as M
from ..operators import model as O
from ..operators import session as S
from ..operators import validate as V
from ..operators.features import engineer_features
from ..operators.split import greedy_fold_keys, with_folds
from ..session import materialize
from ..sources.sinks import write_submission

@dataclass
class RunResult:
    issues: DataFrame
    cv: DataFrame | None
    cv_summary: DataFrame | None
    submission: DataFrame
    submission_check: DataFrame
    importance: DataFrame
    submission_path: str | None


def run_solution(train: DataFrame, test: DataFrame, out_dir: str | None = None, folds: int = 3,
                 form: str = "full", cv: bool = True, changes: dict | None = None,
                 skew_safe: bool = False) -> RunResult:
    """Train on ``train`` (with ``selected``), rank ``test`` (without), by the
    blend of the ranker and the squared-loss model. ``changes`` to the models'
    parameters hold for both. ``skew_safe`` takes all session features and ranks
    from counts, for data in which one session may hold a large share of the rows."""
    issues = V.check_train_test(train, test)
    family = S.add_session_features_skew_safe if skew_safe else S.add_session_features
    tr, te = family(engineer_features(train, form)), family(engineer_features(test, form))
    prep, xtr = O.MatrixPrep().fit_transform(tr)
    xtr = materialize(xtr, "train-matrix")
    xte = materialize(prep.transform(te), "test-matrix")
    changes = changes or {}
    cv_rows = summary = None
    if cv:
        cv_rows = O.cross_validate(with_folds(xtr, greedy_fold_keys(xtr, folds)), folds, params=replace(O.CV_RANKER, **changes))
        summary = M.cv_summary(cv_rows)
    model = O.fit_blend(xtr, ranker=replace(O.RANKER, **changes), squared=replace(O.SQUARED, **changes))
    sub = O.submission(O.score(model, xte), skew_safe=skew_safe)
    sub = materialize(sub, "submission")
    check = V.check_submission(sub, test)
    path = write_submission(sub, out_dir) if out_dir else None
    return RunResult(issues, cv_rows, summary, sub, check, O.feature_importance(model, prep.feature_cols), path)
