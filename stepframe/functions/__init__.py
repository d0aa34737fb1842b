"""Column functions: Column in, Column out, all inside the JVM."""

from .dates import (  # noqa: F401
    FORMATS, age, date_literal, day, due_within, from_daynum, input_, intck, intnx, month, put,
    since_months, to_daynum, today, within_days, year,
)
from .logic import BANDS, BANDS_LONG, BELOW_BANDS, BELOW_BANDS_LONG, band, cap, flag, ifn, ratio  # noqa: F401
from .maths import fdiv, idiv, int_, row_mean, row_sum  # noqa: F401
from .strings import (  # noqa: F401
    cats, catx, chars, join_parts, length, overwrite, overwrite_all, scan, substr, upcase,
)
from .textscan import (  # noqa: F401
    TAG_RULES, lines, marker_lines, match_count, pairs, placeholders, strip, tag, unresolved,
)
