"""tabsense: Spark-native tabular profiling, cleaning, outlier detection, chart data and ML.

Every operator is a function ``(DataFrame, ...) -> DataFrame`` whose work runs in Spark over
the whole input.  Small per-column statistics rows are the only values that reach the driver.
"""

from tabsense.session import get_session, checkpoint_dir, scratch_path

__all__ = ["get_session", "checkpoint_dir", "scratch_path"]
