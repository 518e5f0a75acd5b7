"""Siltstone: layered tables (landed, cleaned, modelled) as plain Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames. Nothing here starts a session, and only
sinks, staging and the watermark lookup run a Spark job.
"""
