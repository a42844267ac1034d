"""Imports every query module so their ``register`` calls run."""

from ledgerlens.plans import (  # noqa: F401
    q_concentration,
    q_load,
    q_overview,
    q_profile,
    q_correlation,
    q_hypothesis,
    q_regression,
)
