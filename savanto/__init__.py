"""Topical-expert analytics on PySpark: ranking, linking, fusion and graph scoring."""
