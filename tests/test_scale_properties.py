"""Properties the scale design relies on."""

from pyspark.sql import functions as F

from changelens.operators import dedup
from changelens.schemas import UNITS
from changelens.plans.common import documents_as_units

SF = "/root/testdata/sf0.001"
UNIT_COLS = UNITS


def _pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_partitioning_does_not_change_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = dedup.min_size_filter(documents_as_units(docs))
    a = _pairs(dedup.shingle_similar_pairs(base))
    b = _pairs(dedup.shingle_similar_pairs(base.repartition(7, "lang_group").sortWithinPartitions(F.rand(3))))
    c = _pairs(dedup.shingle_similar_pairs(base.coalesce(1)))
    assert a == b == c


def test_heavy_list_only_orders(spark):
    """Any heavy-token choice gives the same exact pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = dedup.min_size_filter(documents_as_units(docs))
    ref = _pairs(dedup.shingle_similar_pairs(base, heavy_max=0 + 1, heavy_min_df=10 ** 9))
    for kw in ({"heavy_min_df": 1, "heavy_fraction": 1.0}, {"heavy_min_df": 2, "heavy_max": 50},
               {"heavy_fraction": 0.05}):
        assert _pairs(dedup.shingle_similar_pairs(base, **kw)) == ref


def test_hot_copy_group_is_one_representative(spark):
    text = "\n".join(["one two three four five six seven"] * 4)
    other = "\n".join(["eight nine ten eleven twelve thirteen"] * 4)
    rows = []
    for i in range(300):
        code = text if i % 3 == 0 else other + f" tail{i}"
        rows.append((i, "r", str(i), "<document>", 1, 4, "en", code, len(code), i))
    units = spark.createDataFrame(rows, UNIT_COLS)
    groups = dedup.copy_groups(units)
    hot = groups.filter(F.col("rep_id") == 0).collect()
    assert len(hot) == 100 and all(r.n_copies == 100 for r in hot)
    pairs = dedup.shingle_similar_pairs(units).collect()
    # copies of the hot text never appear as pairs among themselves
    assert all(not (r.a_id % 3 == 0 and r.b_id % 3 == 0) for r in pairs)
    assert len(pairs) <= 200 * 199 // 2


def test_heavy_list_respects_its_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = dedup.min_size_filter(documents_as_units(docs))
    reps = dedup._representatives(base, 5, 5)
    keys = dedup._heavy_tokens(reps, min_df=1, max_tokens=37, fraction=1.0)
    assert len(keys) == 37 and len(set(keys)) == 37
