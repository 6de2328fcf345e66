"""The comparison of configurations keeps its order on the stand-in tables."""

from __future__ import annotations

from peregrin.plans import compare, trip


def test_fusion_is_grounded_and_precise(spark):
    got = {r.config: r for r in compare.comparative_summary(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"fusion", "hybrid", "standard"}
    assert got["fusion"].grounded == 1.0 and got["standard"].grounded == 0.0 and got["standard"].recall == 0.0
    assert got["fusion"].precision >= got["standard"].precision and got["fusion"].recall > 0


def test_profiles_classify_as_themselves(spark):
    from peregrin.functions.scoring import PREFERENCES

    profiles = spark.createDataFrame(list(trip.PROFILES.items()), "label string, centroid array<double>")
    cases = [(1, {"budget": 0.1, "culture": 0.2, "nature": 0.9, "nightlife": 0.1, "relax": 0.3, "adventure": 0.9}), (2, {"budget": 0.7, "culture": 0.3, "nature": 0.2, "nightlife": 0.9, "relax": 0.2, "adventure": 0.3})]
    requests = spark.createDataFrame(cases, "trip_id long, preferences map<string,double>")
    got = {r.trip_id: r.archetype for r in trip.classify_requests(requests, profiles).collect()}
    assert got == {1: "Nature & Adventure", 2: "Nightlife Seeker"} and len(PREFERENCES) == 6
