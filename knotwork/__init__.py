"""knotwork: entity resolution and record linkage as Spark DataFrame operators."""
