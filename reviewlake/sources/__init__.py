"""Readers of landed evidence and writers of reports."""
