"""SQL that solves small linear systems, for the queries whose results come from normal equations."""

from __future__ import annotations


def solved(name: str, source: str, keys: str, k: int, known: str = "") -> str:
    """CTEs that end with `name`: `keys`, the solution w_0 ... w_(k-1), and the columns `known` of `source`.

    `source` has a row for each system with columns a_i_j (i <= j, symmetric) and b_i. Plain elimination, a step a CTE.
    """
    keep = f", {known}" if known else ""
    out, before = [], source
    for t in range(k - 1):
        rows = [f"a_{i}_{j}" for i in range(t + 1) for j in range(i, k)] + [f"b_{i}" for i in range(t + 1)]
        rows += [f"a_{i}_{j} - a_{t}_{i} * a_{t}_{j} / a_{t}_{t} AS a_{i}_{j}" for i in range(t + 1, k) for j in range(i, k)]
        rows += [f"b_{i} - a_{t}_{i} * b_{t} / a_{t}_{t} AS b_{i}" for i in range(t + 1, k)]
        out.append(f"{name}_e{t} AS (SELECT {keys}, {', '.join(rows)}{keep} FROM {before})")
        before = f"{name}_e{t}"
    for i in range(k - 1, -1, -1):
        done = [f"w_{j}" for j in range(i + 1, k)]
        left = " - ".join([f"b_{i}", *(f"a_{i}_{j} * w_{j}" for j in range(i + 1, k))])
        rest = [f"a_{p}_{q}" for p in range(i) for q in range(p, k)] + [f"b_{p}" for p in range(i)]
        now = name if i == 0 else f"{name}_s{i}"
        out.append(f"{now} AS (SELECT {', '.join([keys, *rest, *done, f'({left}) / a_{i}_{i} AS w_{i}'])}{keep} FROM {before})")
        before = now
    return ",\n  ".join(out)


def products(columns: list[str], y: str, alpha: str = "0", free: int = 0) -> str:
    """Select list of centred sums of products a_i_j and b_i of `columns` and `y`, with `alpha` on the diagonal from `free` on."""
    k = len(columns)
    a = [f"COUNT(*) * COVAR_POP({columns[i]}, {columns[j]}){f' + {alpha}' if i == j and i >= free else ''} AS a_{i}_{j}" for i in range(k) for j in range(i, k)]
    return ", ".join([*a, *(f"COUNT(*) * COVAR_POP({columns[i]}, {y}) AS b_{i}" for i in range(k))])
