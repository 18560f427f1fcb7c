"""Inner equi-joins over unsigned columns under interchangeable physical strategies, declared with DataFrames."""
