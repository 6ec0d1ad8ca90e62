"""Exact neighbours, cut in blocks and strips, against all pairs at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creasework.operators import neighbours, similarity


@pytest.mark.parametrize(("rows", "columns", "digits"), [(40, 300, 2), (40, 300, 0), (30, 60, 1), (5, 10, 1), (1, 81, 4)])
def test_nearest_columns_are_those_of_a_stable_sort(rows, columns, digits):
    s = np.round(np.random.default_rng(3).uniform(-1, 1, (rows, columns)), digits)
    s[:, 1] = -np.inf
    assert (similarity.nearest_columns(s, 20) == np.argsort(-s, axis=1, kind="stable")[:, :20]).all()


def test_strips_give_the_neighbours_of_all_pairs(spark):
    """60 blocks in strips of 8, with many ties."""
    r = np.random.default_rng(5)
    vectors = r.integers(-2, 3, (600, 4)).astype(float)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    s = np.round(unit @ unit.T, 4)
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    got = similarity.top_similar(d, k=5, block_rows=10)
    assert sorted((a, b) for a, b, *_ in got.select("id_a", "id_b").collect()) == sorted((a, int(b)) for a in range(600) for b in best[a])
    assert got.where(F.col("rank") > 5).count() == 0


def test_codes_and_buckets_leave_vectors_where_they_are(spark):
    """Codes and memberships hold ids only; before, each took its vector along."""
    classes = spark.createDataFrame([(i, [float(i % 7), 1.0, -float(i)]) for i in range(50)], "cid long, vector array<float>")
    coded = neighbours.codes(classes, 2, 1, 7)
    assert "vector" not in coded.columns and "vector" not in neighbours.buckets(coded, 8, 1).columns
