"""Forecasting, spreadsheet, retrieval and reporting queries as Spark plans."""
