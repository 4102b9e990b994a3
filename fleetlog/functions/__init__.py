from fleetlog.functions.text import any_of, any_of_lower, capture, clean, grab, lowered, match_first, named_values, once, to_int, value_of
from fleetlog.functions.timeutil import day_millis, log_millis, log_time, millis

__all__ = [
    "any_of", "any_of_lower", "capture", "clean", "grab", "lowered", "match_first", "named_values", "once", "to_int", "value_of",
    "day_millis", "log_millis", "log_time", "millis",
]
