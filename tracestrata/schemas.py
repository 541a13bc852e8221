"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT = T.StringType()
_LONG = T.LongType()

CORRUPT = "_corrupt"

# Scalars are read as text and cast later, so that an odd value in one field
# never turns a well-formed line into a corrupt one.
RAW_ARCHIVE = _struct(
    id=_TEXT,
    type=_TEXT,
    created_at=_TEXT,
    actor=_struct(id=_TEXT, login=_TEXT),
    repo=_struct(id=_TEXT, name=_TEXT),
    payload=_struct(
        action=_TEXT,
        size=_TEXT,
        ref_type=_TEXT,
        pull_request=_struct(merged=_TEXT),
        review=_struct(state=_TEXT),
    ),
    **{CORRUPT: _TEXT},
)

EVENT = _struct(
    repo_id=_LONG,
    repo_name=_TEXT,
    actor_id=_LONG,
    actor_login=_TEXT,
    activity=_TEXT,
    payload_type=_TEXT,
    timestamp=T.TimestampType(),
    action=_TEXT,
    push_size=T.DoubleType(),
    create_ref_type=_TEXT,
    delete_ref_type=_TEXT,
    review_state=_TEXT,
    pr_merged=T.BooleanType(),
    event_seq=_LONG,
    hour=_TEXT,
    anno=T.IntegerType(),
    mese=T.IntegerType(),
    giorno=T.IntegerType(),
)

LEDGER = _struct(
    hour=_TEXT,
    day=T.DateType(),
    status=_TEXT,
    total=_LONG,
    distilled=_LONG,
    bad=_LONG,
    updated_at=T.TimestampType(),
)

# A landed file as it was when it was read.
FILE = _struct(path=_TEXT, length=_LONG, checksum=_TEXT)

# A ledger record as it is stored: also the files that the hour was read from, and
# the number of the ledger's snapshot, which orders records without any clock.
LEDGER_STORED = T.StructType(
    [*LEDGER.fields, T.StructField("files", T.ArrayType(FILE)), T.StructField("version", _LONG)]
)

# What was wrong with a landed file: a line of it (numbered from 0, at a byte offset of
# the unpacked text), or the file as a whole (the offset up to which it could be unpacked).
DEFECT = _struct(hour=_TEXT, path=_TEXT, cause=_TEXT, line=_LONG, offset=_LONG)

# The nested ledger document of the older one-file-per-day layout.
LEDGER_DOCUMENT = _struct(
    hours_processed=T.MapType(_TEXT, _struct(total=_LONG, distilled=_LONG, bad=_LONG)),
    hours_not_found=T.ArrayType(_TEXT),
    daily_counts=T.MapType(_TEXT, _LONG),
)

MODEL_NODES = _struct(
    archetype=_TEXT, activity=_TEXT, occurrences=_LONG, in_net=T.BooleanType()
)

MODEL_EDGES = _struct(
    archetype=_TEXT,
    source=_TEXT,
    target=_TEXT,
    frequency=_LONG,
    mean_seconds=T.DoubleType(),
    dependency=T.DoubleType(),
    kind=_TEXT,
)
