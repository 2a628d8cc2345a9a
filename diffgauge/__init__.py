"""Review-change analytics as Spark jobs.

``functions``  column expressions (Column in, Column out)
``sources``    readers and writers
``operators``  jobs (DataFrame in, DataFrame out)
``plans``      the registered queries over the given tables
"""
