"""Customer-360 and next-best-action engine on Spark DataFrames."""

from audience_lens.config import EngineConfig

__all__ = ["EngineConfig"]
