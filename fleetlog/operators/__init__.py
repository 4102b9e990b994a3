from fleetlog.operators.ordered import (
    carry, carry_from, change_points, following, numbered, previous, running_min, running_total,
)
from fleetlog.operators.joins import (
    asof_join, band_join, line_context, pair_requests, window_slice, window_totals,
)
from fleetlog.operators.ranking import ends, first_per, last_per, top_n

__all__ = [
    "carry", "carry_from", "change_points", "following", "numbered", "previous", "running_min", "running_total",
    "asof_join", "band_join", "line_context", "pair_requests", "window_slice", "window_totals",
    "ends", "first_per", "last_per", "top_n",
]
