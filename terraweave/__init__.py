"""terraweave: geospatial features to RDF and back, on Spark DataFrames."""

__version__ = "0.1.0"
