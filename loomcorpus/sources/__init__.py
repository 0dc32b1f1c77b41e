"""Readers that yield canonical records; all are lazy DataFrames and never write to their input."""

from .base import Cursor, DataSource, IndexableAdapter, IndexableSource, Page, TableSource
from .files import FileSource
from .memory import InMemorySource
from .rows import RowSource
from .tables import CsvSource

__all__ = ["CsvSource", "Cursor", "DataSource", "FileSource", "InMemorySource", "IndexableAdapter", "IndexableSource", "Page", "RowSource", "TableSource"]
