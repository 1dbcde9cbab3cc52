"""Lectern: Spark-native analytics for corpora of scholarly Markdown and clipped pages."""
