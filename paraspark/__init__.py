"""paraspark — a Spark-native engine for parallel-text and chat corpora.

Every public function maps ``Column -> Column`` or ``DataFrame -> DataFrame``
and is built from Spark SQL built-ins, so Catalyst plans it and the work runs
on the executors; nothing is collected to the driver.
"""

__version__ = "0.1.0"
