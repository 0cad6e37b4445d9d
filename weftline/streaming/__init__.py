"""Change and diagnostics streams. ``watch`` is the module of the watch query; its function is also ``weftline.watch``."""

from weftline.streaming import watch
from weftline.streaming.diagnostics import latest_stream, wait_for
from weftline.streaming.watch import capped_batches_stream, console, notify, notify_raw, prepare

__all__ = ["capped_batches_stream", "console", "latest_stream", "notify", "notify_raw", "prepare", "wait_for", "watch"]
