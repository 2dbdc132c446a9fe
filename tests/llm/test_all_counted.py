"""The order of near-dedup's shingles comes from all texts."""

import numpy as np
from pyspark.sql import functions as F

from codestrata.llm import near_copies


def test_every_text_is_counted(spark):
    """Of more than 40,000 texts one half was left out."""
    rows = spark.range(45_000).select(F.col("id").alias("i"), F.concat(F.lit("c1 c2 c3 c4 c5 x"), "id").alias("t"), F.col("id").alias("row"))
    (common,) = near_copies.shingle_sets([b"c1 c2 c3 c4 c5"])
    at = common & np.uint64(near_copies.BINS - 1)
    assert near_copies._counts(near_copies._classes(rows))[at].tolist() == [45_000]
    few = rows.where("i < 3000").repartition(3)
    small = near_copies._classes(few, chunk=1000).cache()
    assert near_copies._counts(small)[at].tolist() == [3000] and small.where(F.size("s") > 0).count() == 6
    assert sorted(r["i"] for r in small.select("i").collect()) == list(range(3000))
