"""Shared pieces of text expressions."""

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space characters, for trim and translate.
SPACES = " \t\n\x0b\f\r"


def spaces_sql() -> str:
    """SPACES as a Spark SQL string literal."""
    return "' \\t\\n\\u000b\\u000c\\r'"
