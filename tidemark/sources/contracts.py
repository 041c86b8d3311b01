"""The contract of events on the wire, as JSON Schema, from the same constants that parse them."""

from __future__ import annotations

from tidemark import schemas as S


def wire_schema() -> dict:
    name = {"type": "string", "minLength": 1, "maxLength": S.ID_LENGTH}
    optional = {"type": ["string", "null"], "maxLength": S.ID_LENGTH}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "title": "Viewing event, version 1",
        "type": "object",
        "additionalProperties": False,
        "required": S.WIRE_REQUIRED,
        "properties": {
            "schema_version": {"const": 1},
            "event_id": name,
            "user_id": name,
            "item_id": name,
            "action": {"enum": list(S.ACTIONS)},
            "event_time": {"type": "string", "format": "date-time"},
            "watch_pct": {"type": "number", "minimum": 0, "maximum": 1},
            "session_id": optional,
            "trace_id": optional,
        },
    }
