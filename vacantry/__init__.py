"""Vacantry: job-posting analytics on Spark DataFrames.

Tables of postings, stored pages, pay observations, market benchmarks, stage
events and vectors go in; normalized postings, counted fit scores, selected pay
evidence and reports come out.  Every operator takes DataFrames plus explicit
parameters (never the wall clock) and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
