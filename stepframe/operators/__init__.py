"""Table operators: DataFrame in, lazy DataFrame out."""

from .bygroup import (  # noqa: F401
    by_counter, by_total, count_ge, dedupe_first, first_row, last_row, nested_by_inner,
    nested_by_outer, nth_row, rank_min, remerge, third_or_second, top_n,
)
from .chunking import (  # noqa: F401
    chunk_counts, document_chunks, line_marks, sections, size_chunks, window_chunks,
)
from .columns import (  # noqa: F401
    assign_when, copies, delete_rows, fill, label, map_columns, numbered, numeric_columns, rename,
    select_when, set_format, subset_if,
)
from .merge import lookup_self, merge, not_in, stack, with_scalar  # noqa: F401
from .ordered import (  # noqa: F401
    by_flags, first_value, head, lag, point, retain_fold, row_index, row_number, running_sum,
    split_n, tail,
)
from .parity import (  # noqa: F401
    column_parity, column_profiles, line_coverage, notes, parity, parity_columns, parity_dtypes, parity_shape, parity_values,
    pattern_check, recommendations, report, required, required_columns, rollup, scorecard,
)
from .reshape import expand_months, expand_range, generate, rows, to_long, to_wide  # noqa: F401
from .retrieval import context, fallback_text, nearest, pairs_measured, with_fallback  # noqa: F401
from .sketches import distinct_error, distinct_sketches, sketch_counts, unite_sketches  # noqa: F401
from .sorting import nodupkey, sort  # noqa: F401
from .summary import (  # noqa: F401
    describe, exact_quantiles, freq, into_list, means, nth_highest, row_count,
)
