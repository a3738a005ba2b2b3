from . import nulls, numeric, tails, text

__all__ = ["nulls", "numeric", "tails", "text"]
