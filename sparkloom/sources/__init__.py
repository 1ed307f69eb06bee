"""Reserved for later rounds."""
