"""Every query of the core against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sightline.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUICK = ["fn_norm_name", "fn_split_compound", "fn_parse_condition", "fn_parse_location", "fn_parse_defects", "fn_bbox", "agg_counts_1d", "agg_counts_2d", "agg_percentiles", "agg_duplicate_summary", "agg_fingerprint", "met_classification", "met_confusion_dense", "join_coverage_full", "join_template_cross", "win_contiguous_assign", "win_quota_sample", "win_unique_first_rr", "win_fill_to_quota", "prj_json_answer_valid", "prj_first_wins_dedup"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = c.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in columns)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == rows


def test_all_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.SQL
