from shiftlab.functions.hashing import draw_hash, hash_bucket, row_hash, u60  # noqa: F401
from shiftlab.functions.scalar import band, coerce_double, fill_category  # noqa: F401
