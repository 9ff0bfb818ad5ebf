"""The trip questions composed from the operators, in DataFrame and SQL
form, and helpers to read the physical plan Spark chose."""

from farepath.plans import sql_queries, trip_queries
from farepath.plans.inspect import physical_plan, plan_nodes

__all__ = ["physical_plan", "plan_nodes", "sql_queries", "trip_queries"]
