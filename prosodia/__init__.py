"""Prosodia: DataFrame operators for time-stamped speech, event and text data on Spark."""
