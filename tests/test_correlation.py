"""Correlation of hourly metrics, against numpy, and where one never changes."""
import math

import numpy as np

from logsift.operators import stats as S

SCHEMA = "n_logs long, n_errors long, n_sources long"


def _corr(spark, rows):
    return tuple(S.metric_correlation(spark.createDataFrame(rows, SCHEMA)).first())


def test_against_numpy(spark):
    rows = [(10, 1, 3), (20, 7, 5), (5, 0, 2), (40, 3, 5), (0, 0, 0)]
    a = np.array(rows[:-1], float)
    rate = a[:, 1] / a[:, 0]
    want = [np.corrcoef(a[:, i], rate)[0, 1] for i in (0, 2)]
    assert np.allclose(_corr(spark, rows), want)


def test_constant_metric(spark):
    """Every hour has all sources: their number has no correlation, the other stays."""
    volume, sources = _corr(spark, [(10, 1, 20), (20, 7, 20), (5, 0, 20)])
    assert -1 <= volume <= 1 and math.isnan(sources)
    # no errors at all, or one hour
    assert all(map(math.isnan, _corr(spark, [(10, 0, 3), (20, 0, 5)])))
    assert all(map(math.isnan, _corr(spark, [(10, 1, 3)])))
    assert _corr(spark, []) == (None, None)
