"""Fact tables: schemas, storage and the derived test facts."""
