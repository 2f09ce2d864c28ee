"""changeweave: change-data analytics and anonymisation on Spark DataFrames."""

__version__ = "0.6.0"
