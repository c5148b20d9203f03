"""pagelake: crawled web pages as Spark tables — extraction, versioning,
chunking, retrieval and crawl planning as DataFrame jobs.

Modules: ``pagelake.functions`` (Column expressions), ``pagelake.operators``
(extract, versions, pipeline, retrieval, planning), ``pagelake.sources``
(scans and sinks), ``pagelake.streaming`` and ``pagelake.session``.
"""

__version__ = "0.1.0"
