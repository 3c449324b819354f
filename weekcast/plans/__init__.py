"""Datasets, flows and registered queries.

datasets  the workload's tables derived from the provided star schema
flows     end-to-end flows on user tables (the demand forecast)
queries   registered queries ``(spark, sf_dir) -> DataFrame``
oracle    independent DuckDB SQL twins of the queries
"""
