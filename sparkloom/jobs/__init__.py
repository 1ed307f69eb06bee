"""Jobs over whole tables."""
