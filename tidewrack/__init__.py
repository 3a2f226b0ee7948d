"""DataFrame operators for environmental monitoring time series.

``functions``  column expressions (text, clock, constants)
``sources``    readers and writers
``operators``  DataFrame -> DataFrame operators
``plans``      named queries over the test tables, each with its SQL oracle
"""
