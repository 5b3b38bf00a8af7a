"""epilens: which country-level factors go together with the spread of an
epidemic -- cumulative case tables and wide yearly indicator tables,
analysed with Spark DataFrames.

Subpackages:
  sources    -- CSV/Parquet scans, temp views, the driver-table mapping
  functions  -- column expressions (dates, null-safe statistics, names)
  operators  -- DataFrame-in/DataFrame-out operators
  plans      -- the reference's questions composed, plan inspection
  streaming  -- the same totals over a growing folder of case files
"""

from .session import build_session, ensure_checkpoint_dir, staging_path

__all__ = ["build_session", "ensure_checkpoint_dir", "staging_path"]
