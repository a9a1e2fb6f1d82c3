"""Plan-time helpers: regular expressions, time specifications, globs, units."""
