"""Session-log analytics and corpus operators as lazy Spark DataFrame functions."""
