"""tessera — a Spark-native library for exploring, cleaning, transforming and
statistically analysing large tables.

Every operator is a function ``op(df, ...) -> DataFrame`` built on the public
DataFrame API, so Catalyst plans the work and a cluster runs it.  Operators
never pull row data to the driver; some collect *bounded* scalars (a mean, a
set of bin edges, a category list guarded by ``max_categories``) when the next
plan needs them as literals.
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
