"""Arrow-batched (pandas) UDFs for per-row CDFs that have no JVM builtin.

Kept in a module without postponed annotations so Spark can read the
pandas type hints.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import special as S


def cdf_udf(dist, params):
    """Vectorised CDF of gamma / beta / Student t with fitted parameters."""
    p = [float(v) for v in params]

    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        arr = v.to_numpy(dtype="float64")
        if dist == "gamma":
            return pd.Series(S.gammainc_vec(p[0], np.clip(arr / p[1], 0, None)))
        if dist == "beta":
            return pd.Series(S.betainc_vec(p[0], p[1], np.clip((arr - p[2]) / p[3], 0, 1)))
        if dist == "t":
            return pd.Series(S.t_cdf_vec((arr - p[1]) / p[2], p[0]))
        raise ValueError(dist)

    return cdf
