"""Tables: schemas, readers, writers and fixtures."""
