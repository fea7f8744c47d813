"""nearpass: close approaches of near-Earth objects as Spark jobs.

Everything here takes and returns DataFrames.  Nothing triggers an action
unless its name says so (writers and stream starters), and the present time is
always a parameter, never read inside an operator.
"""
