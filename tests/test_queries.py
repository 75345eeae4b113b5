"""The named queries against their SQL on the smallest tables."""

import pytest
from compare import assert_same
from conftest import SMALL

from echoquorum.plans.registry import ORACLE, QUERIES

CHECKED = [
    "top_shows", "poison_breakdown", "confidence_by_tier", "contributions_by_day", "recent_contributions", "top_contributors", "overlap_stats",
    "disc_confidence_dist", "disc_top_shows", "flagged_activity", "shows_list", "find_shows", "show_detail", "tier_page", "undercounted_episodes",
    "growth_windowed", "episode_grid", "verdict_share", "funnel_shares", "promotion_queue", "promotion_cursor", "episode_votes", "consensus_canonical",
    "disc_digest_groups", "disc_winner", "titles_digest", "minhash_sketch", "identify", "rejected_contributions",
    "dedupe_contributions", "rate_limited", "sketch_batch", "forget", "retract_rederive", "orphan_canonical", "pack_df",
    "contribute_path", "disc_dedupe", "disc_unpromoted", "disc_stamped", "sketch_refresh", "retract_outcome", "upsert_episodes", "seed_episodes",
    "orphans_removed", "disc_requests", "small_requests", "encodings", "jaccard_estimate", "sparkline",
    "retract_kept", "disc_rederived", "forget_everywhere", "sketch_diff", "consensus_deltas", "varints", "json_requests", "identify_requests",
    "pack_objects", "escaped_names",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE[name], SMALL)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == {"codec_round_trip", "pack_lines"}
    assert set(ORACLE) <= set(QUERIES)


def test_codec_round_trip_query(spark):
    rows = QUERIES["codec_round_trip"](spark, SMALL).collect()
    assert len(rows) == 200 and all(r.same for r in rows)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["disc_unique_discs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "o_totalprice" not in read and "o_orderpriority" not in read


@pytest.mark.parametrize("name", ["anti_poison_screen", "anti_poison_verdict", "identify_disc"])
def test_whole_tables_are_asked_for(spark, name):
    out = QUERIES[name](spark, SMALL)
    assert_same(out, ORACLE[name], SMALL)
    if name == "identify_disc":
        from echoquorum.sources import adapters

        want = adapters.disc_contributions(spark, SMALL).select("disc_content_hash").distinct().count() + 10
    else:
        want = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert out.count() == want


def test_document_frequency_needs_no_sketches(spark, monkeypatch):
    from echoquorum.plans import queries as plans

    monkeypatch.setitem(plans.TABLES, "catalogue", None)
    assert plans.QUERIES["document_frequency"](spark, "/root/testdata/sf0.001").columns == ["h", "df"]


def test_the_estimate_compares_no_fingerprints(spark, monkeypatch):
    """Before, the close pairs were joined with both sides for overlaps that are dropped."""
    from echoquorum.operators import identify

    monkeypatch.setattr(identify, "overlap", None)
    assert_same(QUERIES["anti_poison_screen"](spark, SMALL), ORACLE["anti_poison_screen"], SMALL)


def test_contribute_path_shuffles_no_fingerprint_to_find_repeats(spark, monkeypatch):
    """Before, more keys than are broadcast were joined by a shuffle of the fingerprints."""
    from test_retrieval import shuffled

    from echoquorum.operators import identify
    from echoquorum.sources import store

    for module in (store, identify):
        monkeypatch.setattr(module, "BROADCAST_KEYS", 60)
    asked, screen = [], identify.screen
    monkeypatch.setattr(identify, "screen", lambda incoming, references: (asked.append(incoming), screen(incoming, references))[1])
    assert_same(QUERIES["contribute_path"](spark, SMALL), ORACLE["contribute_path"], SMALL)
    before = shuffled(spark)
    assert len(asked[0].collect()) == 200 and shuffled(spark) - before == 0
