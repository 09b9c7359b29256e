"""ledgerlens: on-chain metrics as Spark DataFrame plans.

Entry points:

* ``ledgerlens.sources.registry.Tables`` - logical tables (``from_parquet``, ``from_catalog``), ``as_of`` cut,
  partition windows, ``assert_unique``.
* ``ledgerlens.plans`` - the metrics (``users``, ``bd``, ``economics``, ``deployers``, ``report``), each module with a
  ``dashboard(...)`` returning ``dict[str, DataFrame]``; ``plans.sink.write_dashboard`` publishes one.
* ``ledgerlens.streaming.refresh.start_refresh`` - republishes dashboards when new transaction files arrive.
* ``ledgerlens.session.apply_settings`` - the session settings the metrics rely on (``cluster=True`` for sizing).
"""

__version__ = "0.1.0"
