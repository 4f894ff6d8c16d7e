"""poolscope: swap-market analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames or Columns, runs no Spark action and
collects nothing to the driver, unless its docstring says otherwise (sinks and streams do).
"""
