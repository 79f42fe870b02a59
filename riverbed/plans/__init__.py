"""Named queries over the given tables, each module with ``QUERIES`` and ``ORACLE``."""

from riverbed.plans import audits, checks, dataset, deliveries, depths, events, flows, positions, statistics, streams, study

ALL = [audits, checks, dataset, deliveries, depths, events, flows, positions, statistics, streams, study]
