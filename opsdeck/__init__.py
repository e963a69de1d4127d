"""opsdeck: operations analytics (proxy access logs, fleet inventories) on Spark DataFrames.

Every public function takes DataFrames / Columns plus explicit parameters and returns a
DataFrame / Column without running a job, except where it says so:
``sources.inventory`` counts documents per page before it reads them (``check=False`` leaves
that out), ``sources.landing`` writes tables, and ``streaming.log_stream.start_ingest`` starts a
streaming query.
"""

__version__ = "0.1.0"
