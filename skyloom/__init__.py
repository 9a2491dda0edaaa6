"""A PySpark-native analytics engine for sky-survey catalogues, alert streams and light curves."""
