"""Schemas of the corpus tables. Free-form payloads are JSON text; references are ids of other tables."""

from __future__ import annotations

from pyspark.sql import types as T

from .catalog import APP_LIST_ATTRIBUTES, REPORT_TYPES

_REPORT_HEADER = (
    "id string, android_app_id_reference string, report_date timestamp, scanner_name string, "
    "scanner_version string, scan_status string"
)
_STATISTICS = "id string, report_name string, report_date timestamp, attribute string, value string, n bigint"

TABLES = {
    "android_firmware": (
        "id string, original_filename string, md5 string, sha1 string, sha256 string, file_size_bytes bigint, "
        "absolute_store_path string, indexed_date timestamp, hasFileIndex boolean, hasFuzzyHashIndex boolean, "
        "version_detected int, os_vendor string, partition_info string, tag string"
    ),
    "firmware_file": (
        "id string, firmware_id_reference string, android_app_reference string, name string, parent_dir string, "
        "relative_path string, absolute_store_path string, is_directory boolean, is_symlink boolean, md5 string, "
        "partition_name string, file_size_bytes bigint, meta map<string,string>, tlsh_reference string"
    ),
    "android_app": (
        "id string, firmware_id_reference string, firmware_file_reference string, md5 string, sha1 string, "
        "sha256 string, filename string, packagename string, original_filename string, file_size_bytes bigint, "
        "absolute_store_path string, relative_store_path string, partition_name string, manifest string"
    ),
    "build_prop_file": (
        "id string, firmware_id_reference string, firmware_file_id_reference string, ordinal int, "
        "properties map<string,string>"
    ),
    "app_certificate": (
        "id string, android_app_id_reference string, sha1 string, sha256 string, issuer string, subject string, "
        "public_key_algorithm string, public_key_bit_size string, hash_algo string, signature_algo string, "
        "serial_number string, not_valid_before timestamp, not_valid_after timestamp, is_ca boolean, "
        "ocsp_urls_list array<string>, valid_domains_list array<string>"
    ),
    "app_string": "id string, android_app_id_reference string, string_value string, xref_method_dict_list array<map<string,string>>",
    "string_meta": (
        "id string, app_string_reference string, number_of_words_estimate int, string_length int, "
        "natural_entropy double, shannon_entropy double, hartley_entropy double, language_code string, "
        "language_name string, language_confidence double, url_scheme string, url_domain string, url_path string"
    ),
    "qark_issue": (
        "id string, qark_report_reference string, android_app_id_reference string, category string, "
        "severity string, description string, name string, line_number_list array<int>, file_object string"
    ),
    "tlsh_hash": "id string, firmware_id_reference string, firmware_file_reference string, filename string, digest string",
    "ssdeep_hash": (
        "id string, firmware_id_reference string, firmware_file_reference string, filename string, digest string, "
        "block_size bigint, chunk_7_set array<bigint>, chunk_7_double_set array<bigint>"
    ),
    "ssdeep_edge": "src string, dst string, score int",
    "ssdeep_member": "group string, node string",
    "apk_scanner_log": (
        "id string, timestamp timestamp, level string, message string, module string, tags array<string>, "
        "details map<string,string>, android_app_id string"
    ),
    "aecs_job": "id string, firmware_id_list array<string>, arch string",
    "store_setting": "id string, uuid string, storage_root string, is_active boolean",
    "rq_job": "job_id string, queue string, status string, func_name string, created_at timestamp, ended_at timestamp",
    "generic_file": "id string, filename string, document_reference string, file binary",
    "json_file": "id string, filename string, file binary",
    "image_file": "id string, filename string, file_type string, file binary",
    "statistics_report": _STATISTICS,
    "statistics_reference": "id string, attribute string, value string, reference_id string",
}
for _name in REPORT_TYPES:
    TABLES[_name] = f"{_REPORT_HEADER}, results string"
TABLES["AndroGuardReport"] = (
    f"{_REPORT_HEADER}, packagename string, app_name string, android_version_code string, android_version_name string, "
    "min_sdk_version string, max_sdk_version string, target_sdk_version string, effective_target_version string, "
    "is_multidex boolean, is_androidtv boolean, is_leanback boolean, is_wearable boolean, main_activity string, "
    + ", ".join(f"{name} array<string>" for name in APP_LIST_ATTRIBUTES)
)

# Child tables that go with a deleted parent row, by the column that points to it.
CASCADES = {
    "android_firmware": {
        "firmware_file": "firmware_id_reference",
        "android_app": "firmware_id_reference",
        "build_prop_file": "firmware_id_reference",
        "tlsh_hash": "firmware_id_reference",
        "ssdeep_hash": "firmware_id_reference",
    },
    "firmware_file": {
        "build_prop_file": "firmware_file_id_reference",
        "tlsh_hash": "firmware_file_reference",
        "ssdeep_hash": "firmware_file_reference",
    },
    "android_app": {
        "app_certificate": "android_app_id_reference",
        "app_string": "android_app_id_reference",
        "qark_issue": "android_app_id_reference",
        **{name: "android_app_id_reference" for name in REPORT_TYPES},
    },
}


def schema_of(table: str) -> T.StructType:
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(TABLES)}")
    return T.StructType.fromDDL(TABLES[table])
