"""Reading and writing datasets."""

from .files import (  # noqa: F401
    CHUNK_KEY, compact_chunks, datalines, export, import_csv, parse_fields, read_chunks, read_text_lines, read_texts, save_chunks,
)
from .tables import read, save, split_by_value, write_by_value  # noqa: F401
