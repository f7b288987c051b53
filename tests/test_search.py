"""The registered search makes the whole published search."""

import inspect

import numpy as np

from pulsewide.operators import model as M
from pulsewide.plans.catalog import modelling as Q


def test_search_query_makes_all_trials_and_rounds(spark, sf, monkeypatch):
    asked, ask = [], inspect.signature(M.search_params)

    def note(*given, **named):
        bound = ask.bind(*given, **named)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return M.Search([M.Trial(i, M.draw_params(np.random.default_rng(i)), [0.5]) for i in range(bound.arguments["trials"])])

    monkeypatch.setattr(M, "search_params", note)
    assert Q.m4_search(spark, sf + "/").count() == 20
    assert [(a["trials"], a["rounds"], a["folds"]) for a in asked] == [(20, 400, 3)]
