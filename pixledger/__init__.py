"""Catalogue of generated images as Spark tables.

Operators take and return DataFrames; nothing here runs a job until the caller
asks for rows, except the writers in ``sources.sinks`` and ``streaming``.
"""

from pixledger.session import get_session

__all__ = ["get_session"]
