from . import readers, writers

__all__ = ["readers", "writers"]
