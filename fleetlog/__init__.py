"""fleetlog: device and telephony log analytics as Spark DataFrame jobs."""
