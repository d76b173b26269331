"""Structured Streaming: rolling conversations, idempotent appends, running counters, windows over events."""
from .events import session_windows, sliding_windows, tumbling_windows
from .window import context_window, drop_seen, running_savings

__all__ = ["context_window", "drop_seen", "running_savings", "session_windows", "sliding_windows", "tumbling_windows"]
