"""leadspark: multi-tenant prospect analytics as Spark DataFrame plans.

Every public operator is ``DataFrame -> DataFrame`` (plus explicit
parameters such as ``as_of`` and ``seed``); nothing in the core collects
rows to the driver.
"""

__version__ = "0.1.0"
