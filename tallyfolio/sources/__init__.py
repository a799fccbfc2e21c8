"""Files in (folders, archives, decoders) and tables out (results, raw files)."""
