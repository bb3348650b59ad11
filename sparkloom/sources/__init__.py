"""Files in and out."""

from sparkloom.sources.csv import read_csv, read_csv_text, to_csv

__all__ = ["read_csv", "read_csv_text", "to_csv"]
