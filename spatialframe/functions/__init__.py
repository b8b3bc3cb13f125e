from .columns import (  # noqa: F401
    as_list, clean_nan, hash_hex, hash_int, hash_unit, n_rows, rarefied_detection, rate_per, stars,
)
from .ordering import exact_percentiles, hash_rank, level_percentiles, prefix_sums, take_hash_ranked  # noqa: F401
