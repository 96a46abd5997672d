"""Speech-text alignment and sequence operators as lazy Spark plans."""
