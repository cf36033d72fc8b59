"""Scans and sinks: typed CSV/Parquet readers, train/test loading, submission writers."""

from .readers import load_pair, path_argument, reload_or_build, scan_csv, scan_files, scan_parquet  # noqa: F401
from .sinks import (feature_map, fill_template, run_tagged_path, wide_submission,  # noqa: F401
                    write_csv, write_feature_map, write_importances, write_submission,
                    write_wide_submission)
