"""Text cleanup, identity keys and content hashes as column expressions."""
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

UNKNOWN = "Unknown"


def strip(column):
    return F.btrim(column, F.lit(WHITESPACE))


def clean_text(column):
    """Null, blank and ``?`` become ``Unknown``; anything else loses surrounding whitespace."""
    stripped = strip(column)
    return F.when(column.isNull() | stripped.isin("", "?"), F.lit(UNKNOWN)).otherwise(stripped)


def event_key(source_sha256, source_row):
    """Row position inside an identified file: identical source rows stay two events."""
    return F.sha2(F.concat_ws(":", source_sha256, source_row.cast("string")), 256)


def dimension_key(column):
    return F.substring(F.sha2(column, 256), 1, 16)


def content_hash(record):
    """Hash of a record that does not depend on the order of its keys.

    Accepts a VARIANT, a struct/map or a JSON string; VARIANT prints its keys sorted at every level.
    """
    return F.sha2(F.to_json(record), 256)


def content_hash_json(text):
    return content_hash(F.parse_json(text))


def is_sha256(column):
    return F.coalesce(column.rlike("^[0-9a-f]{64}$"), F.lit(False))
