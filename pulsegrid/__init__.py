"""pulsegrid: wearable health telemetry analytics on Spark.

Entry points:

* ``pulsegrid.session.build_session`` - a session with the library defaults (UTC, AQE, skew joins);
* ``pulsegrid.operators`` - the operators (ingest, rules, aggregates, history, joins, context, keyed
  writes, rendering, ML), plain DataFrame -> DataFrame functions usable on batch and streaming frames;
* ``pulsegrid.streaming.jobs`` - the reading stream (raw fan-out, window aggregate, HR watch);
* ``pulsegrid.plans.catalog`` - every operator registered as a query over the test tables, with oracles.
"""

__version__ = "0.1.0"
