"""matchspark: match-log, map-geometry and corpus analytics as PySpark DataFrames."""
