"""Imports every job module so that the registry is complete."""

from fleetgauge.plans import collection_jobs, range_jobs, schedule_jobs, stat_jobs, stream_jobs, text_jobs  # noqa: F401
from fleetgauge.plans.registry import CHECKS, JOBS  # noqa: F401
