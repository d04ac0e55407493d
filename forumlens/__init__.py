"""forumlens: a PySpark analytics engine for discussion-forum data."""
