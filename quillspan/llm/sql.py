"""SQL equivalents.  The text operators have none: they are tested against brute force."""

SQL: dict[str, str] = {}
