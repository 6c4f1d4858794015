"""Every query of the driver contract, with its SQL where SQL can express it."""

from . import annotation, flow, frames, misc, more, positions, scale, statistics  # noqa: F401
from .core import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "gap_by_class"
