"""Registered queries, grouped by family.  Importing this package fills
``sitelens.plans.registry.QUERIES`` / ``ORACLE_SQL``."""

from sitelens.plans.catalog import survival  # noqa: F401
from sitelens.plans.catalog import spatial  # noqa: F401
from sitelens.plans.catalog import scores  # noqa: F401
from sitelens.plans.catalog import stores  # noqa: F401
from sitelens.plans.catalog import enrich  # noqa: F401
from sitelens.plans.catalog import areas  # noqa: F401
from sitelens.plans.catalog import nearest  # noqa: F401
from sitelens.plans.catalog import patterns  # noqa: F401
from sitelens.plans.catalog import shapes  # noqa: F401
from sitelens.plans.catalog import polygons  # noqa: F401
from sitelens.plans.catalog import density  # noqa: F401
from sitelens.plans.catalog import autocorrelation  # noqa: F401
