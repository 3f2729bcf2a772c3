import pytest

import __spark_entry__ as entry
from check import compare, duck
from tests.conftest import SF

SAMPLE = [
    "a02_read_window", "a14_map_catalog", "a24_merge_upsert", "a28_label_manifest", "b02_fit_budget", "b13_silence_reason",
    "c02_substring_join", "c06_nearest_neighbour", "d02_top_decile", "d09_auc_average_ties", "d22_height_map", "d45_depth_contrast",
    "e02_density_preserving_null", "e12_power_curve", "f09_distance_transform", "f12_structure_tensor", "f16_column_bank",
    "f26_mesh_normals", "g01_separated_peaks", "g07_consensus_labels", "h01_lru_cache", "h02_burst_wall_clock", "i01_format_bytes",
    "j03_differential_hunt", "j13_variant_funnel", "l03_augmented_hann_blend",
]


def test_flagship_runs_and_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns and df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 0.9 * len(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    problems = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    spark.catalog.clearCache()
    assert [p for p in problems if p != "EMPTY"] == []
