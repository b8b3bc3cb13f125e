"""All registered queries; importing a module registers its queries."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import queries_tables  # noqa: F401
from . import queries_summaries  # noqa: F401
from . import queries_spatial  # noqa: F401
from . import queries_profiles  # noqa: F401
from . import queries_resample  # noqa: F401
from . import queries_pixels  # noqa: F401
from . import queries_sources  # noqa: F401
