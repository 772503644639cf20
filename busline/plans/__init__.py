"""Registered queries. Importing the package fills the registry."""

from busline.plans import alerts, crowd, estimates, network, telemetry, timetable, topics, training  # noqa: F401
from busline.plans.registry import ORACLES, QUERIES  # noqa: F401
