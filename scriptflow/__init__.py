"""Data work around Spark scripts: a Parquet ETL and jobs over scripts, logs and attempts."""

import sys

from pyspark import cloudpickle

# Tasks receive the functions of this package with their closures, so it need not be
# installed where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
