"""Editorial review analytics as Spark DataFrame transformations.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing collects rows to the driver.
"""
