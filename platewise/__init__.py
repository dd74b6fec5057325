"""platewise: process-manufacturing quality analytics as Spark DataFrame operators.

Every public operator is a lazy ``DataFrame -> DataFrame`` function; Catalyst plans
the work and nothing data-sized passes through the driver.
"""

__version__ = "0.1.0"
