"""Schemas of the two feeds and of what is made of them."""

from __future__ import annotations

from pyspark.sql import types as T

CRM_FIELDS = (
    "crm_id", "subject", "client_name", "client_company", "relationship_owner", "meeting_date",
    "meeting_time", "meeting_type", "location", "notes", "status", "created_at",
)
CALENDAR_FIELDS = (
    "event_id", "title", "organizer", "attendees", "start_time", "end_time",
    "location", "description", "is_recurring", "status", "created_at",
)

CRM_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in CRM_FIELDS])
CALENDAR_SCHEMA = T.StructType(
    [T.StructField(f, T.ArrayType(T.StringType()) if f == "attendees" else T.BooleanType() if f == "is_recurring" else T.StringType()) for f in CALENDAR_FIELDS]
)

FLAG = "struct<code:string,field:string,raw_value:string,severity:string,message:string>"
FLAGS = f"array<{FLAG}>"
PARTICIPANT = "struct<email:string,display:string,domain:string,is_organizer:boolean,raw:string>"
PARTICIPANTS = f"array<{PARTICIPANT}>"

#: Code -> (severity, message).
FLAG_CODES: dict[str, tuple[str, str]] = {
    "MALFORMED_DATE": ("error", "Date required a fallback pattern to parse"),
    "MALFORMED_DATETIME": ("warning", "Timestamp was missing a component"),
    "UNPARSABLE_DATE": ("error", "Date could not be parsed by any known pattern"),
    "TIME_MISSING": ("warning", "No time of day was supplied"),
    "TIMEZONE_ASSUMED": ("info", "Naive timestamp assumed to be Eastern"),
    "MALFORMED_EMAIL": ("warning", "Email address required repair"),
    "NON_EMAIL_ATTENDEE": ("info", "Attendee is not an email address"),
    "INTERNAL_NO_CLIENT": ("info", "Internal meeting with no client (expected)"),
    "PLACEHOLDER_CLIENT": ("info", "Client field holds a placeholder, not a single client"),
    "DUPLICATE_COLLAPSED": ("info", "Entered twice in the source; records were merged"),
    "UNKNOWN_STATUS": ("warning", "Status is outside both source vocabularies"),
}
SEVERITIES = ("info", "warning", "error")

#: Columns of a normalized event, in order; both feeds give exactly these.
EVENT: dict[str, str] = {
    "source": "string", "source_id": "string", "ordinal": "string", "title": "string", "text": "string", "location": "string",
    "organizer": "string", "owner_name": "string", "client_name": "string", "client_company": "string", "meeting_type": "string",
    "status": "string", "status_raw": "string", "is_recurring": "boolean", "event_date": "date",
    "start": "timestamp_ntz", "end": "timestamp_ntz", "created": "timestamp_ntz", "participants": PARTICIPANTS, "flags": FLAGS, "raw": "string",
}
