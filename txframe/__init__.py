"""txframe: versioned key/value analytics expressed as Spark DataFrame programs."""
