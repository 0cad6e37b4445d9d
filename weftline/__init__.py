"""A PySpark library of workspace analytics and training-text operators."""

from importlib import import_module

#: Public names and their modules, which are imported on first use: executors load only what they run.
_HOME = {"WatchConfig": "weftline.model", "Workspace": "weftline.workspace", "watch": "weftline.streaming.watch"}

__all__ = ["WatchConfig", "Workspace", "watch"]


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(_HOME[name]), name)
