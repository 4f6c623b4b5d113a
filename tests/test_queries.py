"""Registered queries against DuckDB over the smallest tables, and the contract of the entry module."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from trackspark.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["bearing", "all_deltas", "unwrap_angle", "local_tortuosity", "flag_table", "overlap_edges_by_type", "filter_sgolay", "segment_tortuosity", "merge_ambiguous", "detect_stops", "swap_parity", "tracking_correction", "batch_correct", "interpolate_gaps", "histogram", "kde", "kde_tophat", "kde_epanechnikov", "kde_exponential", "kde_linear", "kde_cosine", "kde_scott", "kde_silverman", "load_tracks", "load_settings", "export_tracks", "filter_butter", "filter_kalman", "filter_butter_chunked", "filter_kalman_chunked", "interpolate_gaps_cubic", "interpolate_gaps_cubic_chunked", "import_distance", "correct_global_swap", "fft_spectrum", "fft_spectrum_split", "gmm_fit", "welch_psd", "swapped_segments", "validate_swaps", "event_vector", "scan_trials", "pick_trial_file", "read_track_csv", "read_analysis", "export_segments", "stream_flags", "stream_kalman", "unwrap_angle_chunked", "consecutive_ranges_chunked", "swap_parity_chunked", "detect_stops_chunked", "cross_segment_delta_angular", "cross_segment_delta_angular_chunked"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(df, columns):
    out = df[columns].copy()
    for c in columns:
        if out[c].dtype.kind in "fiub" or out[c].map(lambda v: isinstance(v, (bool, np.bool_)) or v is None).all():
            out[c] = out[c].astype(float)
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, con, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = plain(ours, columns), plain(theirs, columns)
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(entry.oracle_sql().values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 6000
