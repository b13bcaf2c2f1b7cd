"""pagewise: document-layout analytics as Spark DataFrame operators.

Sub-packages: ``functions`` (Column expressions), ``sources`` (readers,
writers, fixtures), ``operators`` (DataFrame -> DataFrame steps), ``plans``
(composed pipelines), ``streaming`` (incremental outline extraction).
"""

__version__ = "0.1.0"
