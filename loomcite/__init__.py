"""Literature and evidence analytics as Spark jobs: DataFrames in, DataFrames out."""
