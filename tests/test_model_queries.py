"""Model queries: features are made once, and trees are trained on as many parts as there are cores."""

import pytest

from creasework.operators import careers, models
from creasework.plans import catalogue
from creasework.sources.driver_tables import League

SF = "/root/testdata/sf0.001"


def test_parts_follow_the_cores_not_the_rows():
    """Before, 11 million rows lay in 220 parts, each of them a task at each level of each tree."""
    assert [models.training_parts(n, 12) for n in (0, 1, 50_000, 50_001, 170_000, 11_000_000)] == [1, 1, 1, 2, 4, 12]
    assert models.training_parts(100_000_000, 12) == 25  # no more rows than fit a task


@pytest.mark.parametrize("name", ["players_at_venue", "prediction_interval", "gbm_holdout_eval", "gbm_bowling_holdout", "gbm_holdout_by_position"])
def test_training_and_prediction_read_settled_features(spark, monkeypatch, name):
    """Before, both planned them from the balls, and players_at_venue the careers once more."""
    seen, train = [], models.train

    def small(d, *args, **kinds):
        seen.append(d)
        return train(d, *args, **(kinds | {"trees": 1, "depth": 2}))

    monkeypatch.setattr(models, "train", small)
    seen.append(catalogue.PLANS[name](League(spark, SF)))
    assert len(seen) >= 2 and all(d.inputFiles() and not any("deliveries" in f for f in d.inputFiles()) for d in seen)
    assert seen[-1].count() > 0


def test_settled_features_are_those_of_the_facts(spark):
    """Careers, also those of earlier seasons only, and features as they are when planned from the balls."""
    g = League(spark, SF)
    season = catalogue._test_season(g)
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(catalogue._bat_settled(g)[0]) == rows(catalogue._bat_features(g))
    bat, bowl = models.split_by_season(g.batting, season), models.split_by_season(g.bowling, season)
    want = models.batting_features(g.batting, g.venue_factors, careers.career_batting(bat, g.venue_factors), careers.chase_split(bat))
    assert rows(catalogue._bat_settled(g, season)[0]) == rows(want)
    want = models.bowling_features(g.bowling, g.venue_factors, careers.career_bowling(bowl, g.venue_factors), least_balls=3)
    assert rows(catalogue._bowl_settled(g, season)[0]) == rows(want)
