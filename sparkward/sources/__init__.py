"""Reading and writing: check specs, the audit trail, files, run payloads."""
