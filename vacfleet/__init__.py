"""vacfleet: maintenance-telemetry control analytics for fleets of relations, on Spark.

Every operator is a pure function ``DataFrame(s) [+ as_of, params] -> DataFrame``
built from DataFrame/SQL expressions so Catalyst can prune, push down and plan it.
"""

__version__ = "0.1.0"
