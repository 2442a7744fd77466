"""Models that are fitted by sums over all rows: logistic regression, and its calibration."""

from .isotonic import calibrate, isotonic
from .logistic import Logistic, fit

__all__ = ["Logistic", "calibrate", "fit", "isotonic"]
