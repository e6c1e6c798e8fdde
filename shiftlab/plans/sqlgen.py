"""Builders for the DuckDB oracle SQL of the sampling operators.

They spell out the plain-window definition of ``hash_rank`` and the draw
index, which the Spark operators compute in bucketed form.
"""

from __future__ import annotations

from collections.abc import Sequence

SEED = 42


def dbl(x: float) -> str:
    """A double literal (a bare ``0.29`` would be DECIMAL in SQL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def h(key: Sequence[str], seed: int = SEED) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(key)}))"


def rank(by: Sequence[str], key: Sequence[str], tiebreak: Sequence[str] = (), seed: int = SEED) -> str:
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    order = ", ".join([h(key, seed), *key, *tiebreak])
    return f"(row_number() OVER ({part}ORDER BY {order}) - 1)"


def draw_idx(parts: Sequence[str], n: str, seed: int = SEED) -> str:
    return f"(('0x' || substr({h(parts, seed)}, 1, 15))::BIGINT % {n})"


def sample_sql(src: str, by: Sequence[str], key: Sequence[str], quota: str,
               tiebreak: Sequence[str] = ()) -> str:
    """Rows of ``src`` with rank < ``quota`` (an SQL expression over ``src`` columns + n)."""
    return (f"SELECT * EXCLUDE (_rk, _n) FROM (SELECT s.*, {rank(by, key, tiebreak)} AS _rk, "
            f"count(*) OVER ({'PARTITION BY ' + ', '.join(by) if by else ''}) AS _n FROM ({src}) s) "
            f"WHERE _rk < {quota}")


def draw_sql(src: str, by: Sequence[str], key: Sequence[str], quota_src: str,
             tiebreak: Sequence[str] = (), copy: str | None = None) -> str:
    """Draws with replacement: ``quota_src`` yields (by..., q) rows; returns src columns, and the draw's number as ``copy``."""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    using = ", ".join([*by, "_rk"]) if by else "_rk"
    gsel = ", ".join(f"qq.{b}" for b in by)
    number = f", d.j AS {copy}" if copy else ""
    return (
        f"SELECT r.* EXCLUDE (_rk, _n){number} FROM "
        f"(SELECT s.*, {rank(by, key, tiebreak)} AS _rk, count(*) OVER ({part}) AS _n FROM ({src}) s) r "
        f"JOIN (SELECT {', '.join(by) + ', ' if by else ''}j, {draw_idx([*by, 'j'], 'sz._n')} AS _rk FROM "
        f"(SELECT {gsel + ', ' if by else ''}unnest(range(qq.q)) AS j FROM ({quota_src}) qq) dj "
        f"JOIN (SELECT {', '.join(by) + ', ' if by else ''}count(*) AS _n FROM ({src}) s2"
        f"{' GROUP BY ' + ', '.join(by) if by else ''}) sz"
        f"{' USING (' + ', '.join(by) + ')' if by else ' ON TRUE'}) d USING ({using})"
    )
