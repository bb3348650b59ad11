"""Helpers that cut, store, order and reuse plans."""

from sparkloom.plans.ordered import ranged, running, running_extremes, sliding, with_ordinal
from sparkloom.plans.stored import settled, shared_folder, written

__all__ = ["ranged", "running", "running_extremes", "settled", "shared_folder", "sliding", "with_ordinal", "written"]
