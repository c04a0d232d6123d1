"""Column functions: all JVM-side but the keyed digests, which Spark lacks."""
