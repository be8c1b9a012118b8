"""Spark-native cataloguing of media file names: infer, resolve, enrich, plan, report."""
