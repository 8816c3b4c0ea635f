"""promoscope: promotion-effectiveness analytics expressed as Spark DataFrame plans.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver. See README.md for the module map.
"""

from promoscope.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
