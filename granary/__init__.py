"""granary: warehouse-modelling and analytics operators for PySpark.

Every operator is a function from DataFrames to DataFrames (or from columns to a
Column). Nothing here plans, schedules or stores by itself: plans are declared
with the DataFrame API and left to Catalyst and AQE.
"""
