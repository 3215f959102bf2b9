"""Network-security analytics operators for PySpark.

Every operator takes DataFrames and returns a DataFrame.  Work stays in
Catalyst expressions; nothing is collected on the driver except where an
operator's docstring says it loops (graph walks), and then only a row count
or an emptiness test comes back.
"""

__version__ = "0.1.0"
