"""Column expressions of the library, all run in the JVM."""

from estuary.operators.loadings import dic_from_ph, do_regression, year_fraction
from estuary.operators.observations import mixed
from estuary.operators.profile import density

__all__ = ["density", "dic_from_ph", "do_regression", "mixed", "year_fraction"]
