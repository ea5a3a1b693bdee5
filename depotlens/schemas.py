"""Declared schemas of the depot's tables, and how a table deviates from its own; reads take the schema of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_DDL = {
    "upload_chunk_request": "request_id bigint, session_id string, repo_id string, checksum binary, data_length int, sent_at timestamp",
    "upload_plan": "upload_id bigint, batch_no bigint, session_id string, repo_id string, missing_chunk_checksums array<binary>, chunks_seen_total int, chunks_seen_unique int, chunks_written_new int, files_written_new int, sent_at timestamp",
    "delta_file": "delta_file_id bigint, repo_id string, chunk_store_id string, base_release_id string, target_release_id string, path string, file_size bigint, old_hash binary, new_hash binary, chunks array<struct<chunk_index:int,byte_offset:bigint,checksum:binary,length:int,source:string>>, created_at timestamp, delivered_at timestamp",
    "chunk": "chunk_store_id string, checksum binary, length int, compressed_length int, created_at timestamp, deleted_at timestamp",
    "checksum_length": "entry_id bigint, chunk_store_id string, checksum binary, length bigint, collected_at timestamp",
    "file_cache": "candidate_key string, file_hash_hex string, file_size bigint, chunk_map array<struct<checksum:string,byte_offset:bigint,length:int>>, first_seen_at timestamp, last_used_at timestamp, evicted_at timestamp",
    "svn_tag_file": "id bigint, tag_id bigint, relative_path string, file_size bigint, last_changed_revision bigint, candidate_key string, file_hash_hex string, scanned_at timestamp",
    "input_item": "item_id bigint, repo_id string, component string, relative_path string, kind string, length bigint, last_write_time_utc timestamp, chunk_map array<struct<byte_offset:bigint,length:int,checksum:binary>>, doc_id bigint",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, repo_id string, created_at timestamp",
    "repository": "repo_id string, tenant_id string, repo_name string, chunk_store_id string, storage_class string",
    "shared_chunk": "checksum binary, label string, length int",
    "size_limit": "item_kind string, limit_bytes bigint, overlap_bytes bigint",
    "mix_target": "source string, target_share double, max_repeats int",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return list(_DDL)


def deviations(df: DataFrame, name: str) -> list[str]:
    """Declared columns that a table lacks or holds in another type; extra columns are no deviation."""
    have = dict(df.dtypes)
    return [f.name for f in schema(name).fields if have.get(f.name) != f.dataType.simpleString()]
