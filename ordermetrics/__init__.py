"""Order-to-payment analytics on Spark.

Parameterised DataFrame operators for an order -> kit -> sample -> report ->
claim -> payment business: every operator takes DataFrames (and, where the
clock matters, an ``as_of`` value) and returns a lazy DataFrame.
"""
