"""leadframe: contact and company data jobs on Spark DataFrames.

Every public function takes and returns DataFrames (or Columns for the
column rules in ``leadframe.functions``); nothing is collected to the driver.
"""

from leadframe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
