from .columns import (block_rank, block_size, block_start, extract_metric, mix,
                      parse_run_name, uniform_int)
from .scans import previous_value, ranked, running_total, slot_numbers
from .skew import salted_join

__all__ = ["block_rank", "block_size", "block_start", "extract_metric", "mix",
           "parse_run_name", "uniform_int", "previous_value", "ranked",
           "running_total", "slot_numbers", "salted_join"]
