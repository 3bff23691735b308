"""Readers that turn files and records into documents."""
