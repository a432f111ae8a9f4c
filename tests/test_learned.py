import inspect

from wearline.operators.supervised import fit_forest
from wearline.plans.catalogue import QUERIES, learned


def test_queries_fit_full_forests(monkeypatch):
    given = {}

    def keep(name, function):
        def run(*args, **options):
            given[name] = inspect.signature(function).bind(*args, **options)
            given[name].apply_defaults()

        return run

    for name in ("life", "tiles", "reports"):
        monkeypatch.setattr(learned.views, name, lambda *a, **k: None)
    monkeypatch.setattr(learned, "interval_labels", lambda *a, **k: None)
    monkeypatch.setattr(learned.fleet, "fleet_risk", keep("fleet", learned.fleet.fleet_risk))
    monkeypatch.setattr(learned.crossval, "temporal_cv", keep("cv", learned.crossval.temporal_cv))
    QUERIES["fleet_risk"](None, "")
    QUERIES["temporal_cv"](None, "")
    fit = given["cv"].arguments["fit"]
    forest = inspect.signature(fit_forest).bind(None, **fit.keywords)
    forest.apply_defaults()
    for found in (given["fleet"].arguments, forest.arguments):
        assert (found["trees"], found["depth"]) == (200, 30)
