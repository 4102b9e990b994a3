from fleetlog.sources.lines import lines_from_texts, merge_lines, read_lines, slice_lines
from fleetlog.sources.archives import is_log_file, list_archives, read_archives, single_member
from fleetlog.sources.tables import (
    append_new_docs, defects_from_json, golden_items, ingest_docs, new_files, page, read_table, save_knowledge,
    write_artifacts, write_docs, write_eval_csv, write_paged, write_table,
)

__all__ = [
    "lines_from_texts", "merge_lines", "read_lines", "slice_lines",
    "is_log_file", "list_archives", "read_archives", "single_member",
    "append_new_docs", "defects_from_json", "golden_items", "ingest_docs", "new_files", "page", "read_table",
    "save_knowledge", "write_artifacts", "write_docs", "write_eval_csv", "write_paged", "write_table",
]
