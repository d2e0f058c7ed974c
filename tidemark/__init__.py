"""tidemark: customer-retention analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or a small set of
them).  Column roles are passed in as a :class:`tidemark.roles.Roles` spec so
that the same code runs on the telecom-style customer table and on the churn
fixture derived from the TPC-H-like driver tables.
"""

__version__ = "0.1.0"
