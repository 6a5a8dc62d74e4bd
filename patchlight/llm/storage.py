"""Where intermediate tables go: the library's folder that the driver and every executor share."""

from ..sources.staged import new_path, shared_folder
from ..sources.staged import staged as saved

__all__ = ["new_path", "saved", "shared_folder"]
