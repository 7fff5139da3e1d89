"""k-means goes on until every region is nearest to the mean of its own cluster."""

import numpy as np

from fieldloom.operators import regions


def test_no_region_is_nearer_to_another_cluster(spark):
    rng = np.random.default_rng(1)
    cols = ["score_mean", "score_zero_prob", "score_std", "tmp_mean", "prec_mean"]
    points = rng.random((3000, len(cols)))  # without groups, so that k-means takes many steps
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["region_id", *cols])
    got = regions.cluster_regions(frame, restarts=2).toPandas()
    z, label = got[cols].to_numpy(), got["cluster_id"].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    centres = np.array([z[label == k].mean(0) for k in range(10)])
    far = ((z[:, None] - centres[None]) ** 2).sum(2)
    assert (far[np.arange(len(z)), label] <= far.min(1) + 1e-6).all()
