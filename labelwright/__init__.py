"""Table-level Spark jobs for auditing labels and evaluating predictions.

* ``labelwright.sources``   - typed readers and writers
* ``labelwright.functions`` - Column expressions (text, rules, calendar, intervals)
* ``labelwright.operators`` - DataFrame -> DataFrame steps
* ``labelwright.plans``     - whole studies assembled from the operators
"""

__version__ = "0.1.0"
