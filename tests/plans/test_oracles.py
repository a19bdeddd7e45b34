"""Registered queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from tracklens.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def connection(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return x if isinstance(x, (str, bool)) else round(float(x), 4)


#: One of each kind; the driver runs them all.
CHOSEN = "looming_v1 looming_v2 looming_v5 looming_v9 looming_v13 multiwindow_candidates collapse_guard_history gt_asof_interp grid_stats_3x3 selected_cells weighted_median_pixels tumbling_event_windows run_summary_rollup failure_summary delta_clip gate_1f_loso log_affine_loso observability_taxonomy compare_buckets gate_2f_loso ridge_loso event_predictor event_predictor_v2 cue_diagnostics compare_summary looming_with_fallback feature_vector last_roi_events stream_tumbling_counts stream_interval_join stream_delta_clip gate_3f_loso sample_images coverage_frontier delta_clips probe_compare cue_residual_score looming_records preview_frames_log surface_payload failure_classes".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, sf, connection, name):
    df = QUERIES[name](spark, sf)
    result = connection.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [result.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want and got
