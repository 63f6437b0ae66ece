"""shipwatch: logistics control-tower analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function meant for
``df.transform``; nothing is collected to the driver except one-row results
of global aggregates that an operator genuinely needs as a scalar.
"""

__version__ = "0.1.0"
