"""caselight: drug-safety paperwork as Spark tables and streams.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function
made of Spark's own expressions, joins and windows.
"""

__version__ = "0.1.0"
