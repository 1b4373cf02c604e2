"""tidewater: a Spark-first engine for dated observations, phrase counts and irregular series."""

__version__ = "0.1.0"
