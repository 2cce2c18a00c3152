from quarry.sources.csv_suite import CASES, discover, load_case, run_suite
from quarry.sources.tables import from_uint64, table

__all__ = ["CASES", "discover", "from_uint64", "load_case", "run_suite", "table"]
