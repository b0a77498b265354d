"""Errors with a public id, an HTTP status, a message and data."""

from __future__ import annotations

# Ids and statuses that clients see.
STATUS = {
    "bad_record.missing_id": 400,
    "bad_record.missing_timestamp": 400,
    "bad_record.invalid_json": 400,
    "bad_record.false_friend": 400,
    "bad_record.multiline": 400,
    "bad_record.too_long": 400,
    "bad_record.not_an_object": 400,
    "bad_record.too_many_fields": 400,
    "bad_record.record_id.invalid.not_a_string": 400,
    "bad_record.record_id.invalid.bad_uuid": 400,
    "bad_record.record_id.zero_uuid": 400,
    "bad_record.entity_id.invalid.not_a_string": 400,
    "bad_record.entity_id.invalid.bad_uuid": 400,
    "bad_record.entity_id.zero_uuid": 400,
    "bad_record.invalid_supersedes_id": 400,
    "bad_record.invalid_locked_until": 400,
    "invalid_timestamp": 400,
    "bad_record.reusing_id": 409,
    "bad_record.superseded_entity_id_mismatch": 409,
    "bad_record.entity_has_active_record": 409,
    "bad_request.cannot_supersede_nonexistent": 400,
    "bad_request.already_superseded": 400,
    "bad_request.duplicate_supersedes": 400,
    "bad_request.upsert.missing_entity_id": 400,
    "bad_request.upsert_timestamp_back": 400,
    "bad_request.supersede_mismatch": 400,
    "bad_request.missing_field_name": 400,
    "bad_request.bad_record_id": 400,
    "bad_request.bad_entity_id": 400,
    "bad_request.no_batches": 400,
    "bad_request.invalid_request": 400,
    "bad_request.unknown_namespace": 400,
    "bad_request.no_such_endpoint": 404,
    "not_found.record": 404,
    "not_found.batch_not_found": 404,
    "lookup_error.multiple_records": 404,
    "internal_error.superseded_record_not_found": 500,
    "internal_error.not_implemented": 500,
    "internal_error.null_value": 500,
    "internal_error.duplicate_id": 500,
    "internal_error.superseded_within_group": 500,
    "unknown_error": 500,
}


class EngineError(Exception):
    def __init__(self, error_id: str, message: str = "", **data: object):
        super().__init__(message or error_id)
        self.error_id, self.message, self.data = error_id, message or error_id, data

    @property
    def status(self) -> int:
        return STATUS.get(self.error_id, 500)

    def envelope(self) -> dict:
        return {"error": {"message": self.message, "data": {"id": self.error_id, **self.data}}}
