"""gain_by_family grows the operator's own number of rounds and levels, a model per fold, whatever order they end in."""

import inspect
import threading

import numpy as np

from latticework.operators import modeling
from latticework.plans.catalog import QUERIES


def test_whole_models_are_grown(spark, monkeypatch):
    grown, lock = [], threading.Lock()

    class Counted:
        def __init__(self, rounds, depth, **_):
            self.sizes, self.gains = (rounds, depth), np.zeros(0)

        def fit(self, df, features, *_):
            with lock:
                grown.append(self.sizes)
            self.gains = np.arange(1.0, len(features) + 1)
            return self

    monkeypatch.setattr(modeling, "Boosting", Counted)
    QUERIES["gain_by_family"](spark, "/root/testdata/sf0.001").collect()
    whole = inspect.signature(modeling.gain_importances).parameters
    assert grown == [(whole["trees"].default, whole["depth"].default)] * 3 == [(50, 6)] * 3
