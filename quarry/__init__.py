"""quarry: incident analytics and severity classification as Spark jobs.

Every operator takes a DataFrame and returns a DataFrame; statistics that a
later step needs (quantiles, modes, encoders) are computed by distributed
aggregations and only their small, size-bounded results reach the driver.
"""

__version__ = "0.1.0"
