"""Readers and writers: manifests, reference tables, catalogue snapshots, plan tables."""
