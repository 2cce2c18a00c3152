from quarry.operators.dedupe import first_match
from quarry.operators.joins import inner_count, inner_rows, join_count, join_rows
from quarry.operators.partition import bucket_of, partition_histogram, partition_offsets

__all__ = ["bucket_of", "first_match", "inner_count", "inner_rows", "join_count", "join_rows", "partition_histogram", "partition_offsets"]
