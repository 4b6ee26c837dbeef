"""voxlake: dense space-time cubes as Spark DataFrames."""
