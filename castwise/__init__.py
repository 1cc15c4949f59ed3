"""castwise: a Spark-native engine for catalogs with ratings, review text and
person-item credits.

Every operator is a function from DataFrames to a DataFrame. Work is expressed
with the DataFrame / SQL API so that Catalyst plans it and the cluster runs it;
nothing is collected to the driver except one-row scalars and model factors of
a bounded size.
"""

__version__ = "0.1.0"
