"""featurelab: feature-engineering experiments on tabular data as PySpark DataFrame programs."""
