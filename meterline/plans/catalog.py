"""Importing this module registers every query."""

from meterline.plans import catalog_prepare  # noqa: F401
from meterline.plans import catalog_profile  # noqa: F401
from meterline.plans import catalog_monitor  # noqa: F401
from meterline.plans import catalog_learn  # noqa: F401
