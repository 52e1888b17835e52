"""What several test files use."""


def python_free(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(w in plan for w in ("Python", "Pandas", "Arrow"))
