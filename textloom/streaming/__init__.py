"""Progress, control and buffers of running jobs."""

from .buffers import ring_buffers
from .control import Cancelled, JobControl
from .progress import progress_by_window, progress_of_segments, running_progress

__all__ = ["Cancelled", "JobControl", "progress_by_window", "progress_of_segments", "ring_buffers", "running_progress"]
