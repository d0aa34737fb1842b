"""Dataset-step analytics on Spark DataFrames.

>>> import stepframe as sf
>>> sf.running_sum(events, "value", by="user_id", order_by=["ts", "event_id"])
"""

from .functions import *  # noqa: F401,F403
from .operators import *  # noqa: F401,F403
from .session import scratch_path, shared_dir, tune  # noqa: F401
from .sources import *  # noqa: F401,F403
