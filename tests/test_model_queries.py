from types import SimpleNamespace

from fieldloom.checks import catalog
from fieldloom.operators import hurdle


def test_model_queries_fit_with_the_settings_of_the_operators(monkeypatch):
    seen = {}

    def train_hurdle(samples, test, settings=None, **more):
        seen["hurdle"] = settings or hurdle.HurdleSettings()
        raise InterruptedError

    def adversarial(train, test, cols, settings=None, **more):
        seen["adversarial"] = settings, more
        return None, None

    nothing = SimpleNamespace(schema=[], columns=[], folded=None, test=None)
    monkeypatch.setattr(catalog.src, "stored", lambda spark, sf, name, make: make())
    monkeypatch.setattr(catalog.src, "samples", lambda spark, sf: nothing)
    for name in ("_tr", "_te", "_folder"):
        monkeypatch.setattr(catalog, name, lambda *of: nothing)
    monkeypatch.setattr(hurdle, "train_hurdle", train_hurdle)
    monkeypatch.setattr(hurdle, "adversarial", adversarial)
    try:
        catalog._trained(None, "")
    except InterruptedError:
        pass
    catalog._adversarial(None, "")
    assert seen == {"hurdle": hurdle.HurdleSettings(most_rows=catalog.LABELLED), "adversarial": (None, {})}
