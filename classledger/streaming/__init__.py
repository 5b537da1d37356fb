"""Sheet files dropped into a folder, imported as they arrive (Structured Streaming)."""

from .drops import start_sheet_imports

__all__ = ["start_sheet_imports"]
