"""DuckDB statements that state the registered queries a second time, over the same parquet tables."""

from oracle.base import render


def statements() -> dict[str, str]:
    from oracle import detection, history, medallion, text

    out: dict[str, str] = {}
    for group in (medallion, detection, history, text):
        out.update({name: render(sql) for name, sql in group.SQL.items()})
    return out
