from fleetlog.streaming.landing import follow_landing

__all__ = ["follow_landing"]
