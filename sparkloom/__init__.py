"""sparkloom: log analytics, corpus statistics and a fragmented relational store as PySpark plans."""
