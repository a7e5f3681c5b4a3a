"""Column functions: sets and message codecs (FN-*)."""
