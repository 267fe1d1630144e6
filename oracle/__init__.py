"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each module returns ``{query_name: sql}``; the SQL states the job's semantics directly
(window functions, QUALIFY, conditional aggregates) over the same derived inputs.
"""
