"""What several test files use."""

import contextlib
import io


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
