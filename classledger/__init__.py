"""classledger: class rosters and gradebooks as Spark DataFrame operators.

Every public operator takes and returns DataFrames keyed by ``account``, so a
single call serves all tenants at once. Nothing is collected to the driver.
"""

__version__ = "0.1.0"
