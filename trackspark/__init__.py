"""trackspark: analytics over multi-point pose tracks as Spark DataFrame operators."""
