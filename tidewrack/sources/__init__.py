"""Readers and writers for station, logger, sonde and table files."""
from ..operators.staging import shared_folder  # noqa: F401
from .readers import (  # noqa: F401
    bind_files_by_key,
    import_stations,
    scan_csv_dir,
    scan_csv_variants,
    scan_headed,
    scan_logger,
    scan_sonde_csv,
    scan_tsv,
    scan_two_space_table,
    select_files,
    text_schema,
)
from .writers import write_csv_table, write_logger  # noqa: F401
