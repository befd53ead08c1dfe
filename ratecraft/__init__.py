"""ratecraft: rating features, training, scoring and service metrics as Spark jobs.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` built from
DataFrame / SQL / Spark ML / Structured Streaming primitives.  No operator
runs an action except where noted (model fitting, bounded size checks).
"""

__all__ = ["session", "constants", "schema"]
