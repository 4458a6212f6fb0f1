from runwise.functions.params import fold_entries, keep_public, parse_params
from runwise.functions.sizes import memory_to_bytes, to_mib

__all__ = ["fold_entries", "keep_public", "memory_to_bytes", "parse_params", "to_mib"]
