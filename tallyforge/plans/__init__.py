"""Named queries: the library's operators applied to whole tables."""
