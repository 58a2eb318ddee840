"""Drift monitoring, listing-table and chat-corpus operators for PySpark.

Every operator takes DataFrames and returns DataFrames; nothing here collects data rows to the driver.
"""

__version__ = "0.1.0"
