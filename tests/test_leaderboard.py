"""T2 on the balanced path: four models, best first, on a target with signal."""

import json

from conftest import SF_MID
from pyspark.sql import functions as F

from callrank.operators import models
from callrank.plans import catalog
from callrank.plans.leaderboard import TUNED, balanced_leaderboard

GRID = {"maxIter": [10, 20], "maxDepth": [3], "stepSize": [0.2], "subsamplingRate": [1.0]}


def test_balanced_leaderboard(spark):
    prepared = catalog._shape_prepared(spark, SF_MID)
    few = {"decision_tree": models.decision_tree(max_depth=5), "random_forest": models.random_forest(trees=20, max_depth=6),
           "boosted_trees": models.boosted_trees(rounds=8, max_depth=3)}
    got = balanced_leaderboard(prepared, catalog.shape_spec(), GRID, few)
    board = got.board.collect()
    assert {r["model"] for r in board} == {*few, TUNED} and len(board) == 4
    assert [r["auc"] for r in board] == sorted((r["auc"] for r in board), reverse=True)
    assert min(r["auc"] for r in board) > 0.7
    tuned = next(r for r in board if r["model"] == TUNED)
    assert json.loads(tuned["params"])["maxIter"] in GRID["maxIter"] and all(r["params"] is None for r in board if r is not tuned)
    # both classes are equal in the train split; test rows are the original ones
    n = {(r["label"], r["synthetic"]): r["count"] for r in got.balanced.groupBy("label", "synthetic").count().collect()}
    assert n[(0, False)] == n[(1, False)] + n[(1, True)]
    test = {r["doc_id"] for r in prepared.where("split = 'test'").collect()}
    assert {r["doc_id"] for r in got.scores.collect()} == test
    assert not test & {r["doc_id"] for r in got.balanced.collect()}
    # a language is a category: its codes stay whole numbers
    assert got.balanced.where(F.col("lang_idx") != F.floor("lang_idx")).isEmpty()
