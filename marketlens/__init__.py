"""Market-profile analytics on PySpark: bars, volume profiles, auction structure, states."""
