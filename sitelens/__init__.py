"""sitelens: store-location analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames; nothing is collected to
the driver.  Date-dependent operators take an explicit ``as_of`` date.
"""

from sitelens.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
