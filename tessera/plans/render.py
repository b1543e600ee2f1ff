"""Text of results and of table lists."""

from __future__ import annotations

from collections.abc import Sequence


def grid(names: Sequence[str], rows: Sequence[Sequence], seconds: float | None = None, chunks: int = 1) -> str:
    """An ASCII grid, right-aligned, with a rule after every row and a footer; no rows give ``empty set``."""
    if not rows:
        return "empty set"
    cells = [["NULL" if v is None else str(int(v)) if isinstance(v, bool) else str(v) for v in row] for row in rows]
    width = [max(len(str(n)), *(len(r[i]) for r in cells)) for i, n in enumerate(names)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda values: "|" + "|".join(f" {v:>{w}} " for v, w in zip(values, width, strict=True)) + "|"
    out = [rule, line(names), rule]
    for r in cells:
        out += [line(r), rule]
    out.append(f"{len(rows)} record  in: {0.0 if seconds is None else seconds:.6f} second  {chunks} chunk")
    return "\n".join(out)


def table_list(tables: Sequence[tuple[int, str, int, Sequence[tuple[str, str, int | None]]]]) -> str:
    """For each table its number, name and rows, then a line ``column-type-length`` each."""
    out = []
    for number, name, rows, columns in tables:
        out.append(f"{number} {name} {rows}")
        out += [f"  {c}-{kind}-{size if size is not None else 4}" for c, kind, size in columns]
    return "\n".join(out)
