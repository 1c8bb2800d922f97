"""DataFrame -> DataFrame operators over whole tables."""
