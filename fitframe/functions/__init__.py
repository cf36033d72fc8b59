"""Row-local column expressions: no shuffle, no job, fully inside codegen."""

from .arith import clamp_low, divide, log_target, py_mod, rain_rate, unlog  # noqa: F401
from .dates import (date_parts, date_text_parts, hour_text, night_flag,  # noqa: F401
                    packed_hour, sas_date_parts, short_year_parts, weekday)
from .nulls import (default_if_null, fill_columns, fill_const, is_present,  # noqa: F401
                    nan_to_null, nans_to_nulls, not_equal_keep_null, null_negatives)
from .text import (arith_crosses, as_text, month_flags, name_parts,  # noqa: F401
                   split_street, text_crosses)
