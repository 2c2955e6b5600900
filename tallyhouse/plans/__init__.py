"""Query programs, one function per query, each ``(Star) -> DataFrame``."""
