"""Medallion analytics on Spark: payloads in, flat silver, derived gold, checked tables out."""
